"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal updates.

Features are hashed into 2**bits slots: single words, pairs of neighbours, and the same for word
shapes (letter case, digits, symbols at the end, repetition of the word before), in which junk
shows whatever its words are.  A document's vector holds log(1 + count) of each slot, scaled to
length one for words and for shapes apart; a score is a sparse dot product.

Training takes a bounded sample of labelled rows: of each label the ``per_class`` rows with the
least hash of doc_id, and of those as many as have ``most_features`` features together.  Scores are
shifted to the share of labels in all labelled rows that may be learnt from.  Everything else
(features, scoring) covers all rows and whole texts, and a score depends on its text alone.

Null texts count as empty and get the score of the bias alone; rows without a label take no part in
training; a doc_id with several labels counts as good if any of them is; rows that repeat a doc_id
are scored each by its own text, and those that are labelled count as examples of their own.  A table
without labels gives scores of 0.5, an empty table an empty result.  Input columns that are called
score or predicted are kept as score_input and predicted_input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.cluster import checkpointed, make_room, small_batches
from loomlog.llm.textops import doc_of, hash_words, mix, slices

BITS = 18


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Rows that are never learnt from: crc32 of doc_id as text leaves 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


_CLASS = np.full(256, 4, dtype=np.uint8)  # other bytes: letters beyond ASCII
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in range(33, 127):
    if _CLASS[_c] == 4:
        _CLASS[_c] = 3


def _shapes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A small number for the shape of each word; the word before counts only in the same text."""
    kind = _CLASS[data]
    first, last = kind[begin], kind[end - 1]
    n = end - begin
    before_last = kind[np.maximum(end - 2, begin)]
    upper = np.concatenate([[0], np.cumsum(kind == 1)])
    shout = (upper[end] - upper[begin]) * 2 > n
    same = np.zeros(len(n), dtype=np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    mark = np.where(last == 3, data[end - 1].astype(np.int64), 0)
    double = (last == 3) & (before_last == 3)
    size = np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), 5)
    return ((((((first.astype(np.int64) * 8 + last) * 128 + mark % 128) * 2 + double) * 2 + (shout & (n > 1))) * 2 + same) * 8) + size


def _vectors(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, slot and value of every feature of some texts."""
    h, begin, end, bounds = hash_words(data, offsets)
    doc = doc_of(bounds)
    n_docs, half = len(bounds) - 1, np.uint64(1 << (bits - 1))
    inside = doc[1:] == doc[:-1]
    docs, slots = [], []
    for group, values in enumerate((h, mix(_shapes(data, begin, end, h, doc).astype(np.uint64) + np.uint64(77)))):
        pair = mix(values[:-1] * np.uint64(0x9E3779B97F4A7C15) + values[1:])[inside]
        base = np.uint64(group) * half
        docs.append(np.concatenate([doc, doc[1:][inside]]))
        slots.append((np.concatenate([values, pair]) & (half - np.uint64(1))) + base)
    out = []
    for d, s in zip(docs, slots):
        key, count = np.unique((d.astype(np.uint64) << np.uint64(32)) | s, return_counts=True)
        d, value = (key >> np.uint64(32)).astype(np.int64), np.log1p(count)
        norm = np.sqrt(np.bincount(d, value * value, minlength=n_docs))
        out.append((d, (key & np.uint64(0xFFFFFFFF)).astype(np.int64), value / np.maximum(norm[d], 1e-12)))
    d, s, v = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(d, kind="stable")
    return d[order], s[order], v[order]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        d, s, v = _vectors(data, offsets, self.bits)
        z = np.bincount(d, self.weights[s] * v, minlength=len(offsets) - 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal updates, one example at a time."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        w = (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            slots, values, label = examples[k]
            i, x = np.append(slots, size), np.append(values, 1.0)
            w = weights(i)
            p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return w[:size].astype(np.float32), float(w[size])


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                d, s, v = _vectors(data, offsets, bits)
                cut = np.searchsorted(d, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(cut, s.astype(np.int32)), pa.ListArray.from_arrays(cut, v.astype(np.float32))],
                    names=["doc_id", "label", "slots", "values"],
                )

    return run


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000, most_features: int = 1 << 23, bits: int = BITS, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, seed: int = 5) -> QualityModel:
    """Fit on the labelled rows of ``docs`` that are not held out.

    per_class and most_features bound the sample: at most that many documents of each label, and that
    many features of 8 bytes of each label, reach the driver.
    """
    small_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    shares = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    first = lambda rows, k: rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    sample = first(usable, 0).unionByName(first(usable, 1))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    vectors = checkpointed(texts.mapInArrow(_features(bits), "doc_id bigint, label int, slots array<int>, values array<float>"))
    examples = []
    for k in (0, 1):
        # Rows that repeat a doc_id are limited once more; the text's features settle their order.
        mine = vectors.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("slots")).limit(per_class)
        sizes = np.array([r[0] for r in mine.select(F.size("slots")).collect()], dtype=np.int64)
        rows = mine.limit(int(np.searchsorted(np.cumsum(sizes), most_features, "right"))).toArrow()
        examples += [(s.values.to_numpy(), v.values.to_numpy(), y.as_py()) for s, v, y in zip(rows["slots"], rows["values"], rows["label"])]
    if not examples:
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0, bits)
    weights, bias = ftrl(examples, bits, epochs, alpha, beta, l1, l2, seed)
    got = [sum(y == k for *_, y in examples) for k in (0, 1)]
    if all(got):
        # From the sample's share of labels to that of all usable rows.
        bias += math.log(shares[1] / shares[0]) - math.log(got[1] / got[0])
    return QualityModel(weights, bias, bits)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` (all columns) with score and predicted."""
    small_batches(docs.sparkSession)
    docs = make_room(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.bits))  # 2**bits floats
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = QualityModel(*shared.value)
        for batch in batches:
            parts = [m.scores(data, offsets) for _, _, data, offsets in slices(batch.column(batch.schema.get_field_index("_text")))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "_text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=[f"c{i}" for i in range(len(kept))] + ["score"])

    kinds = [f.dataType.simpleString() for f in docs.schema]
    put = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce("text", F.lit("")).alias("_text"))
    out = put.mapInArrow(run, ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), "score double"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
