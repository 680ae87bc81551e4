"""Hard negatives against all pairs, for any lists, shelves and blocks, and the edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import hard_negatives as hn
from loomlog.llm.hard_negatives import RESULT, fit_centroids, hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, rid long, list string, score int, cell long"


def brute(rows, is_anchor=lambda i: i is not None and i % 50 == 0, positives=5, negatives=3, window=(50, 95), scale=256):
    rows = [(k, i, g, [math.floor(scale * x) for x in v]) for k, (i, g, v) in enumerate(rows) if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, a, g, v in rows:
        if not is_anchor(a):
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), i, h) for j, i, h, w in rows if j != k]
        for ps, p, _ in sorted((s for s in scores if s[2] == g), key=order)[:positives]:
            far = sorted((s for s in scores if s[2] != g and window[0] * ps <= 100 * s[0] <= window[1] * ps), key=order)
            out += [(a, p, n + 1, i, ps, s) for n, (s, i, _) in enumerate(far[:negatives])]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, g, v, 1, "x", 2, 3) for i, g, v in rows], SCHEMA).repartition(5)
    got = hard_negatives(df, **options)
    assert got.schema.simpleString() == "struct<" + ",".join(x.replace(" ", ":") for x in RESULT.split(", ")) + ">"
    return sorted((tuple(r) for r in got.collect()), key=repr)


def some_rows(seed, n=600, dims=6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, dims)) * 0.3
    rows = [(int(i), int(rng.integers(4)), (middles[rng.integers(7)] + rng.normal(size=dims) * 0.05).tolist()) for i in range(n)]
    hot = [0.25, 0.5, 0.0, -0.25, 0.125, 0.5][:dims]
    rows += [(n + k, k % 3, hot) for k in range(n // 3)]  # one very common vector, with ties everywhere
    return rows


@pytest.mark.parametrize("seed, lists, least", [(1, 1024, 256), (2, 3, 20), (3, 40, 10)])
def test_equals_all_pairs(spark, monkeypatch, seed, lists, least):
    rows = some_rows(seed)
    real = hn.Index

    def small_shelves(*args):
        return real(*args[:-1], least)

    monkeypatch.setattr(hn, "Index", small_shelves)
    monkeypatch.setattr(hn, "_CELLS", 1 << 10)
    monkeypatch.setattr(hn, "_MOST_BROADCAST", 0 if seed == 2 else 1000)
    got = mined(spark, rows, most_lists=lists, sample_rows=200)
    assert got == brute(rows) and got


def test_odd_rows(spark):
    rows = some_rows(4, 120, 3)
    rows += [(None, 1, [0.3, 0.3, 0.3]), (None, 2, [0.3, 0.3, 0.3]), (1000, None, [1.0, 1.0, 1.0]), (1050, 1, None), (1100, 1, [0.5, None, 0.1]), (1150, 1, [math.nan, 0.1, 0.2]), (1200, 2, [math.inf, 0.0, 0.0])]
    rows += [(1250, 2, [0.5]), (1300, 2, []), (1350, 1, [0.2, 0.1, 0.4, 0.9]), (-50, 3, [0.4, -0.2, 0.3]), (-7, 0, [0.4, -0.2, 0.25]), (50, 1, [0.3, 0.3, 0.3]), (50, 1, [0.3, 0.3, 0.3])]
    assert mined(spark, rows) == brute(rows)


def test_other_parameters(spark):
    rows = some_rows(5, 200, 4)
    got = mined(spark, rows, anchors=F.col("vec_id") % 30 == 7, positives=2, negatives=4, window=(10, 80), scale=1000.0)
    assert got == brute(rows, lambda i: i % 30 == 7, 2, 4, (10, 80), 1000)


def test_large_components(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, [rng.uniform(0, 4e6) for _ in range(5)]) for i in range(150)]  # scores above 2**53
    got = mined(spark, rows)
    assert got == brute(rows) and max(r[4] for r in got) > 1 << 53
    assert len(mined(spark, [(i, i % 2, [1e300, 1.0]) for i in range(20)])) >= 0


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [0.5]), (2, 2, [0.4])]) == []
    assert mined(spark, [(0, 1, [0.5])]) == []


def test_centroids():
    x = np.array([[0.0], [0.1], [9.0], [9.1], [0.0]])
    assert sorted(fit_centroids(x, 2).ravel().round(2).tolist()) == [0.05, 9.05]
    assert len(fit_centroids(np.zeros((50, 3)), 8)) == 1
