"""Mixing against a plain version: targets, each row's words, and the documents of the mix."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm import DIR, EDGE, SCHEMA

from loomlog.llm.mixing import mix, mixed_documents, row_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(text):
    return len(WORD.findall(text or ""))


def brute_targets(sizes):
    """Water-filling step by step."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        level = (sum(sizes.values()) - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * level) for s in sizes}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def brute_mix(rows, whole_only):
    """rows: (key, source, size, hash) -> Counter of (key, size, repeats, taken), source by source in order of the hash."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    targets = brute_targets({s: sum(r[2] for r in m) for s, m in by.items()})
    out = Counter()
    for s, members in by.items():
        have = sum(r[2] for r in members)
        rate = min(targets[s] / have, 3.0) if have else 0.0
        whole = round(rate) if abs(rate - round(rate)) < 1e-9 else math.floor(rate)
        left = 0.0 if abs(rate - round(rate)) < 1e-9 else (rate - whole) * have
        for key, _, size, _ in sorted(members, key=lambda r: r[3]):
            part = max(0, min(size, math.floor(left + 0.5)))
            more = int(left > 0.5 and (2 * part >= size if whole_only else part >= size))
            part = size * more if whole_only else part
            out[(key, size, whole + more, whole * size + part)] += 1
            left -= size
        assert abs(left) >= 0
    return targets, out


def tables(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    edge = [(i, t, None if i in (4, 9) else "s" + str((i or 0) % 2)) for i, t in EDGE]
    repeats = [(1, "a b c " * 100, "x")] * 40 + [(k, "d e " * 60, "y") for k in range(20)] + [(99, "q " * 999, "z")] * 3
    return {"docs": docs, "edge": edge, "repeats": repeats}


@pytest.mark.parametrize("name", ["docs", "edge", "repeats"])
def test_mix_against_brute_force(spark, name):
    rows = tables(spark)[name]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    hashed = [((r.doc_id, r.source), r.source, n_words(r.text), r.h) for r in df.withColumn("h", row_hash(17)).collect()]
    for whole_only in (False, True):
        targets, want = brute_mix(hashed, whole_only)
        got = mix(df, whole_only=whole_only).collect()
        assert len(got) == len(rows)
        for r in got:
            assert math.isclose(r.target, targets[r.source], rel_tol=1e-9) and r.taken <= 3 * r.size
        assert Counter(((r.doc_id, r.source), r.size, r.repeats, r.taken) for r in got if r.size) == Counter({k: n for k, n in want.items() if k[1]})
        for s, target in targets.items():
            taken = sum(r.taken for r in got if r.source == s)
            longest = max(x[2] for x in hashed if x[1] == s)
            assert abs(taken - target) <= (longest / 2 + 1 if whole_only else 1)
    assert Counter(map(str, mix(df).collect())) == Counter(map(str, mix(df).collect()))


@pytest.mark.parametrize("name", ["docs", "edge", "repeats"])
def test_mixed_documents(spark, name):
    rows = tables(spark)[name]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, repeats int").repartition(5)
    out = mixed_documents(df)
    assert out.columns == df.columns
    times = Counter()
    for r in mix(df, whole_only=True).collect():
        times[(r.doc_id, r.source, r.size)] += r.repeats
    assert Counter((r.doc_id, r.source, n_words(r.text)) for r in out.collect()) == +times


def test_rows_that_differ_in_other_columns_only(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", k) for k in range(9)] + [(2, "e f g h", "y", 0)] * 4, "doc_id long, text string, source string, extra int")
    out = mixed_documents(df).collect()
    counts = Counter(r.extra for r in out if r.source == "x")
    assert max(counts.values()) - min(counts[k] for k in range(9)) <= 1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).count() == mixed_documents(empty).count() == 0
    assert mixed_documents(empty).columns == empty.columns
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mix(nothing).collect()] == [0, 0] and mix(nothing).agg(F.sum("target")).first()[0] == 0
