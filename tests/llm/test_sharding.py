"""Sharding: every column against a plain version, the law, the groups of equal texts, and edge cases."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm import DIR, EDGE, SCHEMA

from loomlog.llm.queries import queries
from loomlog.llm.sharding import kd_shards


def check(rows, got, shards):
    """Sizes, checksums and slots of every row."""
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def parted(rows, got):
    """Texts whose rows lie in several shards."""
    text = {(i, zlib.crc32((t or "").encode())): t for i, t in rows}
    at = defaultdict(set)
    for r in got:
        at[text[(r.doc_id, r.text_crc32)]].add(r.shard)
    return {t for t, s in at.items() if len(s) > 1}


@pytest.mark.parametrize("sf, shards, most", [("0.001", 4, 1.3), ("0.01", 24, 1.12)])
def test_balance_and_groups(spark, sf, shards, most):
    table = spark.read.parquet(f"{DIR.replace('0.001', sf)}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = kd_shards(table, shards).collect()
    check(rows, got, shards)
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    mean = sum(sums.values()) / shards
    assert len(sums) == shards and max(sums.values()) < most * mean and min(sums.values()) > (2 - most) * mean
    copies = Counter(t for _, t in rows)
    assert all((len(t.encode()) + 8) * copies[t] > mean / 4 for t in parted(rows, got))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    out = queries()["op8_sharding"](spark, DIR)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    check(rows, got, 24)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_one_text_that_outweighs_shards(spark):
    rows = [(i, "the same text " * 20) for i in range(300)] + [(1000 + i, f"text {i} " * 10) for i in range(300)]
    got = kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(rows, got, 8)
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert max(sums.values()) < 1.3 * sum(sums.values()) / 8
    assert parted(rows, got) <= {"the same text " * 20}


@pytest.mark.parametrize("shards", [1, 5, 100])
def test_edge_rows(spark, shards):
    df = spark.createDataFrame([(i, t, 1, "n", 2.0) for i, t in EDGE], "doc_id long, text string, size int, node string, key double")
    got = kd_shards(df, shards).collect()
    check(EDGE, got, shards)


def test_empty_and_own_dimensions(spark):
    assert kd_shards(spark.createDataFrame([], SCHEMA), 4).count() == 0
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    got = kd_shards(df, 4, dims={"id": F.col("doc_id"), "none": F.lit(None)}).collect()
    last = -1
    for s in range(4):  # one dimension: ranges of ids
        ids = [r.doc_id for r in got if r.shard == s]
        assert min(ids) > last
        last = max(ids)


def test_cuts_are_those_of_a_kd_tree(spark):
    """Each half of shards is cut from the other at a weighted median of the dimension in which the node spreads most."""
    table = spark.read.parquet(f"{DIR.replace('0.001', '0.01')}/documents.parquet")
    shards = 24
    rows = [(r.doc_id, r.text or "") for r in table.collect()]
    place = {(r.doc_id, r.text_crc32): r.shard for r in kd_shards(table, shards).collect()}

    def dims(t):
        n = len(t.encode())
        return math.log2(n + 1), len(t) / max(n, 1), t.count(" ") / max(n, 1)

    every = [(dims(t), len(t.encode()) + 8, t, place[(i, zlib.crc32(t.encode()))]) for i, t in rows]
    low, high = ([f(x[0][d] for x in every) for d in range(3)] for f in (min, max))
    cell = lambda x, d: math.floor((x[0][d] - low[d]) / (high[d] - low[d]) * ((1 << 20) - 2)) + 1
    target = sum(x[1] for x in every) / shards
    weight = Counter()
    for x in every:
        weight[x[2]] += x[1]

    def visit(members, first, n):
        if n == 1 or not members:
            return 0
        left = [x for x in members if x[3] < first + n // 2]
        right = [x for x in members if x[3] >= first + n // 2]
        spread = [max(cell(x, d) for x in members) - min(cell(x, d) for x in members) for d in range(3)]
        widest = [d for d in range(3) if spread[d] >= max(spread) - 2]  # a cell more or less is rounding
        assert any(max(cell(x, d) for x in left) <= min(cell(x, d) for x in right) + 2 for d in widest)
        # Off the median by no more than what stands together at the cut.
        goal = sum(x[1] for x in members) * (n // 2) / n
        assert abs(sum(x[1] for x in left) - goal) <= 0.002 * target + max(min(weight[x[2]], target / 4) for x in members) / 2 + max(x[1] for x in members) / 2
        return 1 + visit(left, first, n // 2) + visit(right, first + n // 2, n - n // 2)

    assert visit(every, 0, shards) == shards - 1
