"""Groups by components and rounds, UTF-16 units, failing generators, and what the command line says."""

import random
import stat

import pytest
from pyspark.sql import functions as F

from loomlog import cli
from loomlog.functions import text as T
from loomlog.operators import clean, frequency
from loomlog.plans import commands, generator
from test_groups import distance

ASTRAL = ["😀", "a😀", "😀😀", "ab", "a\U000f0000b", "", "é", "𝔞𝔟𝔠", "x" * 9 + "😀"]


def units(s):
    return [s.encode("utf-16-le")[k : k + 2] for k in range(0, 2 * len(s.encode("utf-16-le")) // 2, 2)]


def test_units(spark):
    rows = spark.createDataFrame([(s,) for s in ASTRAL], "s string").select("s", T.utf16(F.col("s")).alias("u"), T.utf16_length(F.col("s")).alias("n"), T.truncate(F.col("s"), 4).alias("short"), clean.is_noise(F.col("s")).alias("noise")).collect()
    for r in rows:
        assert r.n == len(units(r.s)) == len(r.u) and r.u == T.utf16_text(r.s)
        assert r.short == (r.s if r.n <= 4 else T.cut_text(r.s, 1) + "...")
        assert r.noise == (r.n <= 1)
    assert T.cut_text("😀", 1) == "�" and T.cut_text("a😀b", 3) == "a😀"


def test_distances_count_units(spark):
    keys = sorted({"😀", "ab", "abc", "😀😀", "abcd", "a😀", "𝔞𝔟", "a" * 6, "a" * 4 + "😀"})
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, rank int")
    for threshold in (1, 3):
        got = {(r.low, r.high) for r in frequency.near_pairs(df, threshold).collect()}
        assert got == {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if distance(units(a), units(b)) <= threshold}


def plain_groups(pairs):
    lower, led = {}, {}
    for low, high in pairs:
        lower.setdefault(high, []).append(low)
    for k in sorted(lower):
        if leaders := [x for x in lower[k] if x not in led]:
            led[k] = min(leaders)
    return {f"k{a}": f"k{b}" for a, b in led.items()}


@pytest.mark.parametrize("most_pairs", [10**6, 40, 3])
def test_followers_by_pass_components_and_rounds(spark, most_pairs):
    rng = random.Random(most_pairs)
    pairs = {(k, k + 1) for k in range(0, 30)} | {tuple(sorted(rng.sample(range(40, 140), 2))) for _ in range(70)} | {(200, k) for k in range(201, 230)}
    df = spark.createDataFrame([(f"k{a}", f"k{b}", a, b) for a, b in pairs], "low string, high string, low_order long, high_order long").repartition(3)
    assert {r.high: r.leader for r in frequency.followers(df, most_pairs).collect()} == plain_groups(pairs)


def test_work_does_not_grow_with_the_longest_chain(spark):
    def jobs(n):
        # each key is near the next two alone
        keys = ["".join("ab"[k <= i] * 2 for k in range(n)) for i in range(n)]
        df = spark.createDataFrame([("s", i, k, None) for i, k in enumerate(keys) for _ in range(n - i)], "source string, ord long, command string, timestamp timestamp")
        spark.sparkContext.setJobGroup(f"chain{n}", "")
        out = frequency.group_similar(frequency.count_commands(df)).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert sum(1 + len(r.variations) for r in out) == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{n}"))

    short, long = jobs(6), jobs(18)
    assert long <= short + 3


def program(tmp_path, name, body):
    path = tmp_path / name
    path.write_text("#!/bin/sh\n" + body)
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


def test_reasons_of_failure(tmp_path):
    fails = lambda said, out="": program(tmp_path, f"p{abs(hash(said + out))}", f"echo '{out}'\necho '{said}' >&2\nexit 1\n")
    with pytest.raises(generator.GeneratorMissing, match="logged in"):
        generator.command_call(fails("Error: not authenticated"))("x")
    with pytest.raises(generator.GeneratorFailed, match="rate limit"):
        generator.command_call(fails("HTTP 429"))("x")
    with pytest.raises(generator.GeneratorFailed, match="failed: boom"):
        generator.command_call(fails("boom"))("x")
    assert generator.command_call(fails("boom", "an answer"))("x") == "an answer"
    with pytest.raises(generator.GeneratorFailed, match="within 0.2 seconds"):
        generator.command_call(program(tmp_path, "slow", "exec sleep 5\n"), timeout=0.2)("x")
    with pytest.raises(generator.GeneratorMissing, match="not installed"):
        generator.command_call(str(tmp_path / "none"))("x")


def test_first_program_that_works(spark, tmp_path, monkeypatch):
    good = program(tmp_path, "good", 'echo "good: $1"\n')
    older = program(tmp_path, "older", 'echo "older: $1"\n')
    monkeypatch.delenv("LOOMLOG_ANSWERS", raising=False)
    monkeypatch.setenv("LOOMLOG_GENERATOR", good)
    monkeypatch.setenv("LOOMLOG_GENERATOR_OLDER", older)
    assert generator.make_generator(spark).explain("ls").startswith("good: ")
    monkeypatch.setenv("LOOMLOG_GENERATOR_PROBE", "false")
    assert generator.make_generator(spark).explain("ls").startswith("older: ")
    monkeypatch.setenv("LOOMLOG_GENERATOR_OLDER_PROBE", "sleep 9")
    monkeypatch.setattr(generator, "OLDER_PROBE_S", 0.2)
    with pytest.raises(generator.GeneratorMissing, match="no generator works"):
        generator.make_generator(spark).suggestions([{"pattern": "a", "frequency": 1, "variations": []}], "bash")
    first = generator.FirstThatWorks([generator.Program(good)])
    first("x")
    first.found = generator.Program(str(tmp_path / "gone"))
    with pytest.raises(generator.GeneratorMissing):
        first("x")
    assert first("x") == "good: x"  # looked for anew


def test_problems_are_kept(spark):
    def call(prompt):
        raise generator.GeneratorFailed("did not answer")

    g = generator.CallingGenerator(spark, call)
    assert g.suggestions([{"pattern": "a", "frequency": 1, "variations": []}], "bash") == [] and g.problems == ["did not answer"]


def test_messages(spark, tmp_path, capsys, monkeypatch):
    empty, log = tmp_path / "empty", tmp_path / "log"
    empty.write_text("ls\n\n")
    log.write_text("git status\nnpm test\n")
    assert cli.main(["analyze", "--history-file", str(empty)]) == 0 and "No commands found" in capsys.readouterr().err
    assert cli.main(["search", "x", "--history-file", str(empty)]) == 0 and "No commands found" in capsys.readouterr().err
    assert cli.main(["search", "zzzzzzzzzzzz", "--history-file", str(log), "--shell", "auto"]) == 0 and "No matching commands" in capsys.readouterr().err
    cache = {"shell": "zsh", "suggestions": [{}]}
    assert "made for zsh" in commands.shell_mismatch(cache, "bash") and commands.shell_mismatch(cache, "zsh") is None
    assert commands.shell_mismatch({"shell": "zsh", "suggestions": []}, "bash") is None and commands.shell_mismatch(None, "bash") is None


@pytest.mark.parametrize(("most", "depth"), [(1, 4), (2, 2), (10**6, 4)])
def test_near_pairs_with_shared_segments(spark, most, depth):
    rng = random.Random(most)
    heads = ["git commit -m ", "docker run ", ""]
    keys = sorted({rng.choice(heads) + "".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 9))) for _ in range(90)})
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, rank int")
    for threshold in (0, 1, 3):
        got = [(r.low, r.high) for r in frequency.near_pairs(df, threshold, most, depth).collect()]
        want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if distance(units(a), units(b)) <= threshold}
        assert set(got) == want and len(got) == len(want)
