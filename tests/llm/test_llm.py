"""The training-data operators against brute-force versions, and their edge cases."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, sum int, _h long"

BASE = [f"w{i}" for i in range(60)]
EDGE = [
    (1, " ".join(BASE)),
    (2, "x y " + " ".join(BASE[:40]) + " z"),
    (3, " ".join(BASE) + " tail"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, " ".join(BASE)),
    (7, " ".join(BASE)),
    (None, " ".join(BASE)),
    (8, " ".join(["r"] * 100)),
    (9, "one"),
    (10, "ONE"),
    (11, "long " * 30000),
    (12, "a" * 300000),
    (13, "été " * 30),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, None if i == 9 else "en", None if i in (4, 9) else "s" + str((i or 0) % 2), 0, 1, 2, 3) for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def rank(doc_id):
    return -1 << 63 if doc_id is None else doc_id


def brute_substring(rows, n=20):
    firsts = {}
    words = [(rank(i), WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            firsts[key] = min(firsts.get(key, (i, k)), (i, k))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if firsts[tuple(w[k : k + n])] < (i, k):
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(edge, empty, docs):
    from loomlog.llm.substring_dedup import substring_dedup

    for df, rows in ((edge, EDGE), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = sorted((rank(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df).collect())
        assert got == brute_substring(rows)
    assert substring_dedup(empty).count() == 0


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("winner_repeats", [False, True])
def test_exact_dedup(spark, edge, empty, weak, winner_repeats):
    from loomlog.llm.exact_dedup import exact_dedup, exact_groups

    hash_ = (lambda c: (F.length(c) % 3).cast("string")) if weak else F.md5
    rows = EDGE + [(0, " ".join(BASE) + "  ")] * 3 + [(20, "k e p t")] * 2 if winner_repeats else EDGE
    df = edge if rows is EDGE else spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, hash int, `row` string, kept string")
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or ""), k))
    want = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        want += [(str(i), str(keep[0]), len(members), k == keep[2], hashlib.sha256(norm.encode()).hexdigest()) for i, _, k in members]
    got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_groups(df, hash_).collect()]
    assert sorted(got) == sorted(want)
    kept = exact_dedup(df, hash_)
    assert kept.columns == df.columns
    stays = {norm: min(m, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[:2] for norm, m in groups.items()}
    left = [(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), (r.doc_id, len(r.text or ""))) for r in kept.collect()]
    assert sorted(left, key=repr) == sorted(stays.items(), key=repr)
    assert exact_groups(empty).count() == exact_dedup(empty).count() == 0


def brute_components(rows):
    sets = defaultdict(set)
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets[i].add(s)
    ids = list(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[ids[a]] for y in sets[ids[b]]):
                parent[find(ids[a])] = find(ids[b])
    least = {}
    for i in ids:
        r = find(i)
        key = (1 << 63) - 1 if i is None else i
        least[r] = min(least.get(r, key), key)
    return {i: (None if least[find(i)] == (1 << 63) - 1 else least[find(i)]) for i in ids}


@pytest.mark.parametrize("long", [2, 32])
def test_jaccard_join(spark, edge, empty, docs, long):
    from loomlog.llm.jaccard_join import jaccard_components, near_dedup

    rng = np.random.default_rng(3)
    near = []
    for i in range(60):
        w = [f"b{k}" for k in range(120)]
        for k in rng.choice(120, size=int(rng.integers(0, 7)), replace=False):
            w[k] = f"e{i}_{k}"
        near.append((100 + i, " ".join(w)))
    cut = []  # texts and shorter parts of them, around the threshold
    for i in range(80):
        n = int(rng.integers(40, 400))
        w = [f"c{i}_{k}" for k in range(n)]
        cut.append((1000 + 2 * i, " ".join(w)))
        keep = -(-(n - 4) * int(rng.integers(74, 82)) // 100) + 4
        cut.append((1001 + 2 * i, " ".join(w[:keep])))
    several = [(i % 20, t) for i, (_, t) in enumerate(cut)]  # doc_ids that stand for several texts
    for rows in (EDGE, [(r.doc_id, r.text) for r in docs.collect()], near, cut, several):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in jaccard_components(df, long=long).collect()}
        assert got == brute_components(rows)
    assert near_dedup(edge).columns == edge.columns
    assert jaccard_components(empty).count() == near_dedup(empty).count() == 0
