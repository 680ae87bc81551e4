"""Assembly against a sequential version, search and safety examples, and the commands end to end."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomlog.functions import text as T
from loomlog.operators import redact, safety
from loomlog.operators.assemble import plain_entries
from loomlog.operators.frequency import analyze_frequency
from loomlog.operators.search import search
from loomlog.plans import commands, files, render
from loomlog.plans.generator import CannedGenerator
from loomlog.sources.history import detect_shell, history_path, lines_of, tail_lines

ENTRY = "source string, ord long, command string, timestamp timestamp, line_number int"


def entries(spark, cmds):
    return spark.createDataFrame([("s", i, c, None, i + 1) for i, c in enumerate(cmds)], ENTRY)


def walk(lines):
    """One pass over plain lines."""
    out, stamp, held, begin = [], None, [], None
    for i, raw in enumerate(lines):
        if re.fullmatch(r"#[0-9]{9,11}", raw.strip()):
            stamp = int(raw.strip()[1:])
            continue
        body = raw.rstrip()
        if body.endswith("\\"):
            begin = i if not held else begin
            held.append(body[:-1])
            continue
        joined = "\n".join([*held, body]).strip()
        if joined:
            out.append((i, joined, stamp, (begin if held else i) + 1))
        if held or joined:
            stamp = None
        held = []
    return out


def test_plain_assembly(spark):
    rng = random.Random(4)
    kinds = ["#1700000000", "#1700000060", "a", "b \\", "", " ", "\\", "c", "#12"]
    logs = {str(k): [rng.choice(kinds) for _ in range(rng.randint(0, 12))] or [""] for k in range(400)}
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in logs.items()], "k string, t string")
    got = {}
    for r in plain_entries(tail_lines(lines_of(df, "k", "t"))).withColumn("e", F.unix_seconds("timestamp")).collect():
        got.setdefault(r.source, []).append((r.ord, r.command, r.e, r.line_number))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, v in logs.items() if (w := walk(v))}


def test_similar_commands(spark):
    df = entries(spark, ["docker ps", "docker ps -a"] * 3)
    top = analyze_frequency(df, 1, 50).first()
    assert (top.pattern, top.frequency, top.variations) == ("docker ps", 6, ["docker ps -a"])


@pytest.mark.parametrize("command,rules", [("rm -rf /x", [0]), ("rm -rf my-dir", []), ("sudo rm -rf /x", [0, 1]), ("rm -rf ${X}", [0]), ("cp $A b", [2]), ("dd if=a of=b", [4]), ("dd if=a status=progress", []), ("chmod 777 x", [5]), ("chmod 0777 x", [])])
def test_rules(spark, command, rules):
    assert sorted(r.rule for r in safety.flagged(entries(spark, [command])).collect()) == rules


def test_search_and_redaction(spark):
    df = entries(spark, ["git status"] * 3 + ["docker-compose up -d", "git commit -m x"])
    assert search(df, "git").first().command == "git status"
    assert search(df, "dokcer").first().command == "docker-compose up -d"
    assert search(df, "  ").count() == 0
    assert T.tokenize_text("docker-compose up -d") == ["docker", "compose", "up", "d"]
    row = spark.createDataFrame([('curl -H "Authorization: Bearer ghp_abc123def456" https://a',)], "c string")
    r = redact.scrub_column(row, "c").first()
    assert (r.c, r.redacted_count) == ('curl -H "[REDACTED]" https://a', 1)


def test_commands(spark, tmp_path):
    log = tmp_path / "h"
    log.write_text("\n".join(["git status", "npm test", "ls"] * 6 + ["rm -rf /tmp/x"]) + "\n")
    (tmp_path / "suggest_bash.json").write_text(json.dumps([{"pattern": "git status", "type": "alias", "code": "alias gs='git status'", "name": "gs", "explanation": "", "safety": "safe"}]))
    cache, out = str(tmp_path / "cache.json"), str(tmp_path / "out.sh")
    r = commands.analyze(spark, "bash", str(log))
    assert r["total_commands"] == 13 and r["unique_commands"] == 3 and len(r["alerts"]) == 1
    assert "git status" in render.analysis_table(r) and json.loads(render.analysis_json(r))["totalCommands"] == 13
    assert commands.run_search(spark, "git", "bash", str(log))[0]["command"] == "git status"
    assert commands.suggest(spark, CannedGenerator(str(tmp_path)), "bash", str(log), cache=cache)[0]["name"] == "gs"
    assert "alias gs" in commands.apply(cache, out) and files.exists(out)
    assert "gs" in commands.report(spark, cache=cache, shell="bash", history_file=str(log))
    with pytest.raises(commands.HistoryMissing):
        commands.analyze(spark, "bash", str(tmp_path / "none"))
    with pytest.raises(ValueError):
        commands.apply(str(tmp_path / "none"), out)


def test_shell_and_path():
    assert detect_shell(None, {"SHELL": "/bin/zsh"}, "linux") == "zsh"
    assert detect_shell("bash", {"SHELL": "/bin/zsh"}) == "bash"
    assert history_path("bash", None, {"HISTFILE": "/x"}) == ("/x", "env")
    assert history_path("zsh", None, {}, "/h") == ("/h/.zsh_history", "default")
