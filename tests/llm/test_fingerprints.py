"""Fingerprints against a plain version, and their edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from test_llm import DIR, EDGE, SCHEMA

from loomlog.llm import fingerprints as fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


def mix(h):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * m) & MASK
    return h ^ (h >> 33)


def word_hash(word):
    h = fp.hash_words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0]
    return int(h[0])


def brute_lexicon(texts):
    df = Counter(w for t in texts for w in set(WORD.findall(t or "")))
    return {w for w, n in df.items() if fp.RARE * len(texts) <= n <= fp.COMMON * len(texts)}


def brute_subsets(text, lexicon, level=None):
    """(rate, subset) -> the sorted terms that survive in it."""
    terms = sorted({word_hash(w): w for w in WORD.findall(text or "")}.items())
    inside = [(h, w) for h, w in terms if w in lexicon] or terms
    level = len(inside).bit_length() - 1
    out = {}
    for s in range(fp.DENSE):
        left = tuple(h for h, _ in inside if mix(h ^ (0xD1B54A32D192ED03 * (s + 1)) & MASK) >> 61)
        out[("dense", s)] = left
    for r in range(0, fp.SUBSETS, 2):
        both = [(mix((h + (0x632BE59BD9B4E019 * (r + 1))) & MASK), h) for h, _ in inside]
        for s in (r, r + 1):
            draws = [(d >> 32 if s > r else d & 0xFFFFFFFF, h) for d, h in both]
            for rate in range(level + 1, level + 1 + fp.RATES):
                out[(rate, s)] = tuple(h for d, h in draws if d & ((1 << rate) - 1) == 0)
    return level, out


def brute_likeness(a, b):
    (la, x), (lb, y) = a, b
    if la < 0 or lb < 0:
        return float(la == lb)
    shared = set(x) & set(y)
    used = [k for k in shared if x[k] or y[k]]
    return sum(x[k] == y[k] for k in used) / len(used) if used else float(x == y)


def brute_compare(rows):
    lexicon = brute_lexicon([t for _, t in rows])
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        own, other, after = (brute_subsets(x, lexicon) for x in (t, edited, nxt))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_likeness(own, other), brute_likeness(own, after))
    return out


@pytest.mark.parametrize("parts", ["1", "7"])
def test_compare_against_brute_force(spark, parts):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    edge = {i: t for i, t in EDGE if i is not None and i != 11}
    extra = [(1000 + i, t) for i, t in edge.items()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for rows in (docs + extra if parts == "7" else extra, extra[:1], extra[:2]):
            df = spark.createDataFrame(rows, "doc_id long, text string")
            got = {r.doc_id: r for r in fp.compare_edited(df, fp.lexicon(df)).collect()}
            want = brute_compare(rows)
            assert got.keys() == want.keys()
            prints = {}
            for i, (n, sha, edited, after) in want.items():
                r = got[i]
                assert (r.n_chars, r.edited_sha256) == (n, sha)
                # 16-bit signatures agree by chance once in 65,535
                assert abs(r.near_edited - edited) < 0.02 and abs(r.near_next - after) < 0.02
                text = next(t for j, t in rows if j == i) or ""
                assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lexicon(spark):
    rows = [(i, t) for i, t in enumerate(r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = brute_lexicon([t for _, t in rows])
    assert fp.lexicon(df).tolist() == sorted(map(word_hash, words))
    few = fp.lexicon(df, max_terms=50)
    assert len(few) <= 50 and set(few.tolist()) <= set(map(word_hash, words))


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d")] * 3 + [(5, "e f g h"), (5, "e f g i"), (5, "e f g i"), (4, None), (3, ""), (3, "x" * 200_000)]
    df = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], "doc_id long, text string, run int, fingerprint string, sum int")
    out = fp.compare_edited(df, fp.lexicon(df)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in out) == sorted((str(i), len(t or "")) for i, t in rows)
    assert all(0 <= x <= 1 for r in out for x in (r.near_edited, r.near_next))
    assert {(str(r.doc_id), r.fingerprint) for r in fp.fingerprint(df, fp.lexicon(df)).collect() if r.doc_id is None} == {("None", next(r.fingerprint for r in out if r.doc_id is None))}
    empty = spark.createDataFrame([], SCHEMA)
    assert len(fp.lexicon(empty)) == 0 and fp.compare_edited(empty, fp.lexicon(empty)).count() == 0


def rows_of(*texts):
    return fp._rows_of([" ".join(t) for t in texts], np.zeros(0, np.uint64))


@pytest.mark.parametrize("part, least", [(1, 1.0), (2, 0.25), (4, 0.1)])
def test_texts_of_different_sizes(part, least):
    long = [f"term{i}" for i in range(400)]
    a, b, c = rows_of(long, long[: 400 // part], [f"other{i}" for i in range(400 // part)])
    assert fp.likeness(a, b) == fp.likeness(b, a) >= least
    assert fp.likeness(a, c) < 0.05


def test_very_long_texts_and_few_changes():
    n = 1 << 18
    long = [f"t{i}" for i in range(n)]
    a, b, c = rows_of(long, long[: n * 9 // 10] + [f"e{i}" for i in range(n // 10)], long[: n // 4])
    assert a[0] == c[0] + 2 and fp.likeness(a, b) > 0.6
    alike = []
    for k in range(40):
        words = [f"w{k}_{i}" for i in range(50)]
        one, two = rows_of(words, [*words, "new"])
        assert fp.likeness(one, two) > 0.8
        alike.append(np.mean(one[1] == two[1]))
    assert 0.03 < np.mean(alike) < 0.3  # a dense lexicon lacks the new word once in eight
