"""Sources longer than a task: any cut into chunks or blocks gives what one pass gives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlog.operators import chunks
from loomlog.operators.assemble import assemble, extended_entries, plain_entries
from loomlog.operators.clean import clean, is_noise
from loomlog.operators.frequency import count_sequences, digest
from loomlog.sources.history import lines_of, read_lines, scan_lines, tail_lines, texts_as_one
from loomlog.sources.tail import last_lines, read_tail
from test_groups import walk as walk_extended
from test_log import walk as walk_plain

PLAIN = ["#1700000000", "#1700000060", "a", "b \\", "", " ", "\\", "c", "#12", " d ", "#1700000099 "]
EXTENDED = [": 1700000000:0;a", ": 1700000060:0;b \\", "c", "d \\", "", " ", "#1700000000", ": 1700000090:0;e\rf", "\\", ": 1:0;g"]


def logs_of(kinds, seed, n=250, longest=14):
    rng = random.Random(seed)
    return {str(k): [rng.choice(kinds) for _ in range(rng.randint(1, longest))] for k in range(n)}


def entries_by_source(df):
    got = {}
    for r in df.withColumn("e", F.unix_seconds("timestamp")).collect():
        got.setdefault(r.source, []).append((r.ord, r.command, r.e, r.line_number))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
@pytest.mark.parametrize("kinds, parse, walk", [(PLAIN, plain_entries, walk_plain), (EXTENDED, extended_entries, walk_extended)])
def test_assembly_in_chunks(spark, monkeypatch, kinds, parse, walk, chunk, limit):
    monkeypatch.setattr(chunks, "_MOST_BROADCAST", limit)
    logs = logs_of(kinds, chunk, n=250 if limit else 40)
    logs["long"] = ["b \\"] * 30 + ["c"] + ["#1700000005"] + [" "] * 25 + ["a", "a"] if parse is plain_entries else [": 1700000060:0;b \\"] + ["d \\"] * 20 + [": 1700000060:0;x"] * 5 + ["d \\", "c", "c"]
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in logs.items()], "k string, t string")
    got = entries_by_source(parse(tail_lines(lines_of(df, "k", "t")), chunk))
    assert got == {k: sorted(w) for k, v in logs.items() if (w := walk(v))}


def test_both_formats_in_chunks(spark):
    logs = {f"p{k}": v for k, v in logs_of(PLAIN, 5, 40).items()} | {f"e{k}": [EXTENDED[0], *v] for k, v in logs_of(EXTENDED, 6, 40).items()}
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in logs.items()], "k string, t string")
    got = entries_by_source(assemble(lines_of(df, "k", "t"), chunk=3))
    assert got == {k: sorted(w) for k, v in logs.items() if (w := (walk_extended if k[0] == "e" else walk_plain)(v))}


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 16])
def test_runs_over_borders(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for source in ("x", "y", "z"):
        places = sorted(rng.sample(range(400), 100))  # some chunks are empty, some hold noise only
        rows += [(source, i, rng.choice(["ls", "git status", "git status", "npm test", "x", "make"]), None) for i in places]
    df = spark.createDataFrame(rows, "source string, ord long, command string, timestamp timestamp").repartition(3)
    cleaned = clean(df, chunk)
    want, runs = [], Counter()
    for source in ("x", "y", "z"):
        kept = []
        for r in rows:
            if r[0] == source and len(r[2]) > 1 and r[2] != "ls" and (not kept or kept[-1][2] != r[2]):
                kept.append(r)
        want += kept
        for w in range(2, 6):
            runs.update(" && ".join(r[2] for r in kept[k : k + w]) for k in range(len(kept) - w + 1))
    assert sorted(map(tuple, cleaned.collect())) == sorted(want)
    assert {r.key: r["count"] for r in count_sequences(cleaned, chunk=chunk).collect()} == runs
    assert set(cleaned.columns) == set(df.columns) and not cleaned.filter(is_noise(F.col("command"))).count()


def test_no_window_over_a_whole_long_source(spark):
    lines = tail_lines(lines_of(spark.createDataFrame([("s", "\n".join(["a", "b \\", "#1700000000", "c"] * 500))], "k string, t string"), "k", "t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = plain_entries(lines, 100).select(F.spark_partition_id().alias("p"), "ord")
        spread = [r["count"] for r in tasks.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(spread) == 1000 and len(spread) > 1 and max(spread) < 700


FILES = {
    "plain": b"a\nb\r\nc",
    "ended": b"a\nb\n",
    "blank": b"\n\n\r\n",
    "lone": b"a\rb\r\nc\r",
    "cr_end": b"a\r\n",
    "marked": b"\xef\xbb\xbfa\nb",
    "marked_ended": b"\xef\xbb\xbfa\nb\n",
    "empty": b"",
    "one": b"x",
    "long": b"".join(b"line %d of it%s" % (i, b"\r\n" if i % 3 else b"\n") for i in range(3000)),
    "one_long_line": b"y" * 5000 + b"\n" + b"z" * 5000,
    "umlaut": "ä ö\n😀\n".encode(),
}


@pytest.mark.parametrize("block", [7, 64, 1000, 1 << 27])
def test_scan_equals_whole_files(spark, tmp_path, block):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content if block > 50 or len(content) < 2000 else content[:900])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = sorted((r.source.split("/")[-1], r.line_idx, r.n_lines, r.raw) for r in scan_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = sorted((r.source.split("/")[-1], r.line_idx, r.n_lines, r.raw) for r in read_lines(spark, str(tmp_path)).collect())
    assert got == want and {w[0] for w in want} == set(FILES) - {"empty"}


def test_packed_files_are_refused(spark, tmp_path):
    import gzip

    (tmp_path / "a.gz").write_bytes(gzip.compress(b"a\n" * 500))
    with pytest.raises(ValueError, match="a.gz"):
        scan_lines(spark, str(tmp_path))


def test_texts_as_one(spark):
    rng = random.Random(2)
    texts = [(i, None if i % 9 == 0 else "\n".join(str(k) for k in range(rng.randint(0, 5)))) for i in rng.sample(range(-50, 200), 90)]
    got = sorted((r.line_idx, r.raw, r.n_lines, r.source) for r in texts_as_one(spark.createDataFrame(texts, "i long, t string").repartition(4), "i", "t", "one", chunk=16).collect())
    want = [line for _, t in sorted(texts) for line in (t or "").split("\n")]
    assert got == [(k, x, len(want), "one") for k, x in enumerate(want)]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_texts_as_one_with_null_and_repeated_keys(spark, most):
    texts = [(-17, "a\nb"), (-16, ""), (-1, "c"), (0, None), (5, "d\n"), (1 << 60, "e"), (None, "f\ng")]
    lines = texts_as_one(spark.createDataFrame(texts[::-1], "i long, t string").repartition(3), "i", "t", "one", chunk=16, most=most)
    assert [r.raw for r in lines.orderBy("line_idx").collect()] == ["a", "b", "", "c", "", "d", "", "e", "f", "g"]
    twice = texts_as_one(spark.createDataFrame([(1, "x\ny"), (1, "x\ny"), (2, "z")], "i long, t string"), "i", "t", "one", most=most)
    assert [r.raw for r in twice.orderBy("line_idx").collect()] == ["x", "y", "x", "y", "z"]
    assert not texts_as_one(spark.createDataFrame([], "i long, t string"), "i", "t", "one", most=most).count()


def test_sequences_move_no_texts(spark, tmp_path):
    """The runs of one log are counted from digests, and its commands stay with their chunk once they are stored."""
    from loomlog import catalog

    text = "\n".join(f"command {k} {'x' * 300}" for k in range(20))
    spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.queries()["one_log_sequences"](spark, str(tmp_path))
    assert "Bucketed: true" in df._jdf.queryExecution().executedPlan().toString()
    assert "binary" in count_sequences(clean(catalog._one_log_entries(spark, str(tmp_path))), known_by=digest).schema["key"].dataType.simpleString()
    counted = count_sequences(clean(catalog._one_log_entries(spark, str(tmp_path))))
    want = sorted((r.k, r["count"], r.window) for r in counted.select(F.md5("key").alias("k"), "count", "window").collect())
    assert sorted((r.key, r["count"], r.window) for r in df.collect()) == want


@pytest.mark.parametrize("block", [1, 5, 1 << 16])
@pytest.mark.parametrize("keep", [1, 2, 100, 5000])
def test_last_lines(block, keep):
    import re

    for content in FILES.values():
        want = re.split(r"\r?\n", content.decode())[-keep:]
        assert [x.decode() for x in last_lines(lambda a, n: content[a : a + n], len(content), keep, block)] == want


def test_tail_reads_the_end_alone(spark, tmp_path):
    size, path = 4 << 30, tmp_path / "huge"
    tail = b"".join(b"command %d\n" % i for i in range(6000))
    with open(path, "wb") as f:  # a hole of 4 GB before the lines
        f.truncate(size)
        f.seek(size)
        f.write(b"\n" + tail)
    read = []

    def read_at(at, n):
        read.append(n)
        with open(path, "rb") as f:
            f.seek(at)
            return f.read(n)

    lines = last_lines(read_at, path.stat().st_size, 5000)
    assert lines == [b"command %d" % i for i in range(1001, 6000)] + [b""] and sum(read) < 10 << 20
    rows = read_tail(spark, str(path)).orderBy("line_idx").collect()
    assert [r.raw.encode() for r in rows] == lines and {r.n_lines for r in rows} == {5000} and [r.line_idx for r in rows] == list(range(5000))


def test_tail_equals_the_tail_of_a_scan(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    key = lambda r: (r.source.split("/")[-1], r.line_number, r.raw)
    want = sorted(map(key, tail_lines(read_lines(spark, str(tmp_path)), 150).collect()))
    assert sorted(map(key, tail_lines(read_tail(spark, str(tmp_path), 150), 150).collect())) == want
    assert sorted(map(key, tail_lines(read_tail(spark, str(tmp_path / "*"), 150), 150).collect())) == want
    with pytest.raises(FileNotFoundError):
        read_tail(spark, str(tmp_path / "none"))
