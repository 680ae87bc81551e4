"""near_dedup against a plain version that decides row by row."""

from collections import Counter

from pyspark.sql import functions as F
from test_llm import DIR, EDGE, brute_components

SCHEMA = "doc_id long, text string, source string"


def brute_near_dedup(rows):
    """Rows that stay; of a component those with the least id, of which any one may stay."""
    part = brute_components([(k, t) for k, (_, t) in enumerate(rows)])
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(part[k], []).append(row)
    order = lambda i: (i is None, i or 0)
    out = []
    for members in groups.values():
        least = min((i for i, _ in members), key=order)
        out.append({(i, t) for i, t in members if i == least})
    return out


def check(spark, rows):
    from loomlog.llm.jaccard_join import near_dedup

    df = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)
    out = near_dedup(df)
    assert out.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in out.collect())
    want = brute_near_dedup(rows)
    assert sum(left.values()) == len(want)
    for choice in want:
        hit = next(x for x in choice if left[x] > 0)
        left[hit] -= 1


def text(name, changed=()):
    return " ".join(f"{name}{k}" if k not in changed else f"new{k}" for k in range(100))


def test_null_and_repeated_ids(spark):
    a, b, c, d = (text(x) for x in "abcd")
    near_a, near_c = text("a", [50]), text("c", [7])
    check(spark, [(None, a), (None, b), (5, near_a)])
    check(spark, [(None, a), (None, b), (None, ""), (None, None), (None, " "), (5, near_a), (None, near_c), (None, c)])
    check(spark, [(1, a), (1, near_a), (1, b), (2, b), (2, c), (2, d), (0, near_c), (3, d), (3, d), (3, d)])
    check(spark, [(None, a)] * 40 + [(None, d)] + [(7, b)] * 30 + [(7, c)])


def test_edge_rows_and_documents(spark):
    check(spark, EDGE)
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()])


def test_colliding_hashes_lose_no_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loomlog.llm import jaccard_join

    real = jaccard_join.hashes
    # All rows whose id is below 4 have one first hash; the second tells them apart.
    monkeypatch.setattr(jaccard_join, "hashes", lambda i, t: (F.when(i < 4, F.lit(77)).otherwise(real(i, t)[0]), real(i, t)[1]))
    a, b, c, d = (text(x) for x in "abcd")
    check(spark, [(1, a), (2, b), (3, c), (3, c), (4, text("a", [50])), (5, text("b", [3])), (6, d), (None, c)])


def test_bitmaps_bound_differences(spark):
    import numpy as np

    from loomlog.llm.jaccard_join import differing, parities

    rng = np.random.default_rng(3)
    rows, wants = [], []
    for n_a, n_b, common in [(60, 66, 55), (64, 65, 60), (1000, 1100, 900), (1000, 1030, 3), (130, 120, 0), (5, 3000, 2)]:
        h = rng.integers(0, 1 << 63, n_a + n_b - common, dtype=np.uint64)
        a, b = h[:n_a], h[n_a - common :]
        bits = parities(np.concatenate([a, b]), np.array([0, n_a, n_a + n_b]))
        rows.append((len(rows), bits[0].tolist(), bits[1].tolist()))
        wants.append((n_a + n_b - 2 * common, common))
    rows.append((len(rows), None, rows[0][2]))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    got = [tuple(r) for r in df.orderBy("i").select(differing(F.col("a"), F.col("b")), differing(F.col("b"), F.col("a"))).collect()]
    assert all(x == y for x, y in got) and got[-1] == got[-2] == (0, 0)
    assert all(0 < x[0] <= most for x, (most, _) in zip(got[:5], wants)) and got[3][0] > 400


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    """Texts of which each holds a common passage among words of its own, and some near copies of them."""
    from loomlog.llm import jaccard_join
    from loomlog.llm.jaccard_join import jaccard_components

    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [f"{own(k, 50)} {passage} {own(k + 1000, 50)}" for k in range(80)]
    texts += [t + f" more{k}" for k, t in enumerate(texts[:20])]
    made = []
    met = jaccard_join._Join.met

    def counted(self, mixed):
        out = met(self, mixed)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join._Join, "met", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(df, long=8).collect()}
    assert got == {k: k - 80 if k >= 80 else k for k in range(100)}
    assert len(made) == 1 and made[0] < 100  # the passage alone would make thousands
