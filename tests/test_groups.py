"""Near pairs, greedy groups, the extended format and streams, each against a plain version."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlog.operators import frequency
from loomlog.operators.assemble import extended_entries
from loomlog.sources.history import known_history_paths, lines_of, tail_lines
from loomlog.streaming.counts import running_counts, windowed_counts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def some_keys(seed, n, longest):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("ab ") for _ in range(rng.randint(0, longest))) for _ in range(n)} | {"git status", "git statsu", "gitstatus", "xgit status"})


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_near_pairs(spark, threshold):
    keys = some_keys(threshold, 250, 10)
    got = [(r.low, r.high) for r in frequency.near_pairs(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, rank int"), threshold).collect()]
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if distance(a, b) <= threshold}
    assert len(got) == len(set(got)) and set(got) == want


def test_greedy_groups(spark):
    rng = random.Random(9)
    keys = some_keys(5, 80, 9)
    rows = [("s", i, k, None) for i, k in enumerate(k for k in keys for _ in range(rng.randint(1, 5)))]
    rng.shuffle(rows)
    rows = [("s", i, r[2], None) for i, r in enumerate(rows)]
    counts, first = Counter(r[2] for r in rows), {}
    for _, i, k, _ in rows:
        first.setdefault(k, i)
    order, taken, want = sorted(counts, key=lambda k: (-counts[k], first[k])), set(), {}
    for i, lead in enumerate(order):
        if lead in taken:
            continue
        also = [k for k in order[i + 1 :] if k not in taken and distance(lead, k) <= 3]
        taken |= {lead, *also}
        want[lead] = (counts[lead] + sum(counts[k] for k in also), also)
    df = spark.createDataFrame(rows, "source string, ord long, command string, timestamp timestamp")
    got = {r.pattern: (r.frequency, r.variations) for r in frequency.group_similar(frequency.count_commands(df)).collect()}
    assert got == want


def walk(lines):
    """One pass over extended lines: (index of the last line, command, epoch, number of the first line)."""
    out, held = [], None
    for i, raw in enumerate(lines):
        m = re.fullmatch(r":\s*([0-9]{9,11}):([0-9]+);([^\n\r\u2028\u2029]*)", raw)
        body = (m[3] if m else raw).rstrip()
        if m and body.endswith("\\"):
            held = ([body[:-1]], int(m[1]), i)
        elif m:
            if body.strip():
                out.append((i, body.strip(), int(m[1]), i + 1))
        elif held:
            if body.endswith("\\"):
                held[0].append(body[:-1])
                continue
            command = "\n".join([*held[0], body]).strip()
            if command:
                out.append((i, command, held[1], held[2] + 1))
            held = None
        elif body.strip():
            out.append((i, body.strip(), None, i + 1))
    return out


def test_extended_assembly(spark):
    rng = random.Random(6)
    kinds = [": 1700000000:0;a", ": 1700000060:0;b \\", ": 1700000070:5;\\", "c", "d \\", "", " ", "#1700000000", ": 1700000090:0;e\rf", ": 1700000092:0;k\u2028l", ": 1:0;g", ":1700000099:0; h ", ": 1700000091:0;i j \\", "\\"]
    logs = {str(k): [rng.choice(kinds) for _ in range(rng.randint(1, 12))] for k in range(500)}
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in logs.items()], "k string, t string")
    got = {}
    for r in extended_entries(tail_lines(lines_of(df, "k", "t"))).withColumn("e", F.unix_seconds("timestamp")).collect():
        got.setdefault(r.source, []).append((r.ord, r.command, r.e, r.line_number))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(w) for k, v in logs.items() if (w := walk(v))}


def test_streams(spark, tmp_path):
    entries = spark.createDataFrame([("git status", "2024-01-01 10:00:00"), ("ls", "2024-01-01 10:00:00"), ("git status", "2024-01-02 11:00:00"), ("npm test", "2024-01-01 12:00:00")], "command string, timestamp string")
    entries.write.json(str(tmp_path / "in"))
    for name, counts in (("running", running_counts), ("windowed", windowed_counts)):
        stream = spark.readStream.schema("command string, timestamp timestamp").json(str(tmp_path / "in"))
        query = counts(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted((r.command, r.frequency, str(r.last_used)) for r in spark.table("running").collect()) == [("git status", 2, "2024-01-02 11:00:00"), ("npm test", 1, "2024-01-01 12:00:00")]
    assert sorted((r.command, str(r.window.start)[:10], r.frequency) for r in spark.table("windowed").collect()) == [("git status", "2024-01-01", 1), ("git status", "2024-01-02", 1), ("npm test", "2024-01-01", 1)]


def test_known_paths():
    assert known_history_paths({}, "/h", "linux") == {"bash": "/h/.bash_history", "zsh": "/h/.zsh_history", "powershell": "/h/.local/share/powershell/PSReadLine/ConsoleHost_history.txt"}
    assert known_history_paths({"APPDATA": "/a"}, "/h", "win32")["powershell"].startswith("/a")
