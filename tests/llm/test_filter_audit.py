"""The filter audit against a plain pass over every order, and its edge cases."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from loomlog.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, lang string, quality int, mask int, part string, of long, digest string"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": smaller}
        out.append({k for k, v in bad.items() if v})
    return out


def brute(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    failed, out = failures(rows), []
    for part in {g or "" for _, _, g in rows}:
        own = [(i, f) for (i, _, g), f in zip(rows, failed) if (g or "") == part]
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [i for i, f in left if letter in f]
                kept = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                redundant = sum(letter in f for _, f in own) - len(gone)
                found.append((part, "".join(order), step, len(kept), len(gone), redundant, sum(f == {letter} for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone), letter))
                left = kept
        out += [(*x[:-1], shapley[x[-1]]) for x in found]
    return sorted(out)


def some_rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(150)] + ["É", "ABCDEFGH", "a#b", "ß", "x&", "Ab"]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 100, 150, 156])]) for _ in range(rng.choice([0, 1, 199, 200, 230, 700]))) for _ in range(60)]
    texts += ["\t".join(f"u{k}" for k in range(200)), "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "Aé" * 3 + "é" * 97, "x" * 300_000, "one word still\x1cone " * 200, "r " * 400, "", " \n ", None]
    rows = [(rng.randrange(80), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(300)]
    return rows + [(None, texts[3], "en"), (None, texts[3], "en"), (None, "only here", "fr"), (-5, texts[0], "en"), (-5, texts[0], "en")]


def audit(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, g, 1, 2, "p", 3, "d") for i, t, g in rows], SCHEMA).repartition(5)
    return fa.filter_audit(docs, spark.createDataFrame([(*x, "z") for x in labels], LABELS + ", part string"))


def test_equals_brute_force(spark):
    rows = some_rows()
    labels = [(k, int(k % 2 == 0), int(k % 3 == 0)) for k in range(0, 80, 2)] + [(1, 0, None), (1, 1, 0), (None, 1, 1), (999, 1, 1)]
    got = audit(spark, rows, labels)
    assert set(got.columns) == set(COLUMNS)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(rows, labels)


def test_empty_tables(spark):
    assert audit(spark, [], [(1, 1, 1)]).count() == 0
    got = audit(spark, [(1, None, None)], []).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and sum(r.removed for r in got) == 120


def test_colliding_hashes_are_told_apart(monkeypatch):
    real = fa.hash_words

    def weak(data, offsets):
        h, *rest = real(data, offsets)
        return h % np.uint64(3), *rest

    texts = ["a b c a", "aa bb ab ba aa", "x", "", "q w e r t y " * 30]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(fa, "hash_words", weak)
    words, distinct = fa.distinct_words(data, offsets)
    assert words.tolist() == [len(t.split()) for t in texts] and distinct.tolist() == [len(set(t.split())) for t in texts]


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_do_not_change_counts(monkeypatch, piece):
    monkeypatch.setattr(fa, "_PIECE", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice("AaZ#é &|") for _ in range(rng.randrange(40))) for _ in range(30)]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    want = [sum(1 << k for k, x in enumerate("ABCD") if x in f) for f in failures([(0, t, "") for t in texts])]
    assert fa.text_masks(data, offsets).tolist() == want
