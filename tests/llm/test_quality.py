"""The classifier's features and scores against a plain version, and its edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import EDGE, SCHEMA

from loomlog.llm import quality
from loomlog.llm.textops import slices

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1
BITS = 14


def mix(h):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * m) & MASK
    return h ^ (h >> 33)


def word_hash(word):
    return int(quality.hash_words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0])


def kind(c):
    return 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if 33 <= c < 127 else 4


def brute_score(text, weights, bias):
    words = WORD.findall((text or "").encode())
    hashes = [word_hash(w) for w in words]
    shapes = []
    for k, w in enumerate(words):
        n, last = len(w), kind(w[-1])
        upper = sum(kind(c) == 1 for c in w) * 2 > n and n > 1
        same = k > 0 and hashes[k] == hashes[k - 1]
        mark = w[-1] if last == 3 else 0
        double = last == 3 and kind(w[-2] if n > 1 else w[0]) == 3
        shape = ((((((kind(w[0]) * 8 + last) * 128 + mark) * 2 + double) * 2 + upper) * 2 + same) * 8) + min(int(math.log2(n)), 5)
        shapes.append(mix((shape + 77) & MASK))
    z, half = bias, 1 << (BITS - 1)
    for group, values in enumerate((hashes, shapes)):
        pairs = [mix((a * 0x9E3779B97F4A7C15 + b) & MASK) for a, b in zip(values, values[1:])]
        counts = Counter((v & (half - 1)) + group * half for v in values + pairs)
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values())) or 1
        z += sum(float(weights[s]) * math.log1p(c) / norm for s, c in counts.items())
    return 1 / (1 + math.exp(-max(-35, min(35, z))))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    return quality.QualityModel(rng.normal(size=1 << BITS).astype(np.float32), 0.3, BITS)


def test_scores_against_brute_force(spark, model):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [t for _, t in EDGE if t is None or len(t) < 20_000] + docs + ["the cat sat on mat", "mat is red", "mat mat MAT Mat!! 9x é"]
    rows = list(enumerate(texts))
    got = quality.score_quality(spark.createDataFrame(rows, "k long, text string"), model).collect()
    assert all(abs(r.score - brute_score(texts[r.k], model.weights, model.bias)) < 1e-6 for r in got) and len(got) == len(rows)


def test_score_depends_on_its_text_alone(model):
    def scores(*texts):
        return [x for _, _, d, o in slices(pa.array(texts)) for x in model.scores(d, o)]

    alone = scores("mat is red")[0]
    assert scores("the cat sat on mat", "mat is red")[1] == pytest.approx(alone, abs=1e-12)
    assert scores("mat", "", "mat is red")[2] == pytest.approx(alone, abs=1e-12)


def test_clashing_columns_repeats_and_long_texts(spark, model):
    rows = [(1, "a b", 5.0, "p", "q"), (1, "a b", 6.0, "p", "q"), (None, None, None, None, None), (2, "w " * 400_000, 1.0, "p", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, Predicted string, score_input string")
    out = quality.score_quality(df, model)
    assert out.columns == ["doc_id", "text", "score_input_input", "Predicted_input", "score_input", "score", "predicted"]
    got = out.collect()
    assert sorted(str(r.score_input_input) for r in got) == ["1.0", "5.0", "6.0", "None"]
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in got)


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    real = quality.ftrl
    monkeypatch.setattr(quality, "ftrl", lambda examples, *a: (seen.append(examples), real(examples, *a))[1])
    docs = spark.createDataFrame([(i // 2, " ".join(f"w{i}_{k}" for k in range(50))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    quality.train_quality(docs, labels, per_class=30, bits=BITS)
    assert [sum(y == k for *_, y in seen[0]) for k in (0, 1)] == [30, 30]
    quality.train_quality(docs, labels, per_class=30, most_features=1000, bits=BITS)
    assert all(0 < sum(len(s) for s, _, y in seen[1] if y == k) <= 1000 for k in (0, 1))
    held = {r.doc_id for r in labels.filter(quality.held_out(F.col("doc_id"))).collect()}
    import zlib

    assert held == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_no_labels_and_empty_tables(spark, model):
    empty = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = quality.train_quality(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none)
    assert quality.score_quality(spark.createDataFrame([(1, "a")], "doc_id long, text string"), m).first().score == 0.5
    assert quality.score_quality(empty, quality.train_quality(empty, none)).count() == 0


def plain_ftrl(examples, size, epochs, alpha, beta, l1, l2, seed):
    """Coordinate by coordinate."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            slots, values, label = examples[k]
            x = [*zip(slots.tolist(), values.tolist()), (size, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def test_training_equals_plain_ftrl():
    rng = np.random.default_rng(4)
    examples = []
    for _ in range(60):
        slots = rng.choice(1 << 6, size=rng.integers(0, 12), replace=False).astype(np.int32)
        examples.append((slots, rng.random(len(slots)).astype(np.float32), int(rng.integers(2))))
    options = (3, 0.5, 1.0, 0.05, 0.5, 9)
    weights, bias = quality.ftrl(examples, 6, *options)
    want = plain_ftrl(examples, 1 << 6, *options)
    assert np.allclose(weights, want[:-1], atol=1e-6) and bias == pytest.approx(want[-1], abs=1e-9) and np.count_nonzero(weights) > 20


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.score_quality(docs.select("doc_id", "text"), quality.train_quality(docs, labels))
    rows = scored.join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert np.mean([x > y for x in good for y in bad]) > 0.97
