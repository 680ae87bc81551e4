"""I-Match fingerprints over randomised lexicon subsets.

Terms are a text's words.  Their document frequencies are counted exactly over all documents; the
lexicon holds the terms whose share of the documents lies between ``rare`` and ``common`` (a band of
the inverse document frequency).  The rare end bounds it: with m distinct terms a document on
average there are at most m / rare terms that frequent.  Should that still be more than
``MAX_TERMS``, the rare end moves to where that many are left; so the broadcast lexicon is bounded.

The distinct lexicon terms of a document are sorted and hashed, whole and in order, once for each of
several random subsets of the lexicon: what survives in a subset gives its signature.

* ``DENSE`` subsets drop an eighth of the lexicon each, as in the published method.  They agree for
  texts that differ in a few lexicon terms.
* A text of which half is replaced shares no such subset.  ``SUBSETS`` families of smaller ones, nested
  at the rates 1/2, 1/4, 1/8 ... serve those: a text of m terms is hashed through the subsets at the
  rates 2**-(L+1) to 2**-(L+RATES), L = floor(log2 m), where few of its terms survive.

The rates do not depend on the document, so texts of different sizes are compared at those that both
have.  Likeness is the share of equal signatures among the compared subsets in which either text has
a term: 1 for equal texts, 0 if no subset agrees.  Texts without a lexicon term use all their terms.

Null texts count as empty; empty fingerprints are alike (1) only to each other.  Other columns of the
input are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.cluster import checkpointed, small_batches
from loomlog.llm.textops import doc_of, hash_words, mix, prefix_sums, run_hash, slices, sort_within

RARE, COMMON = 1 / 8192, 1 / 10
MAX_TERMS = 1 << 22
DENSE = 8
SUBSETS = 48
RATES = 4
_PENDING = 1 << 20
_CHUNK = 1 << 18


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct term, in sorted order."""
    h, _, _, bounds = hash_words(data, offsets)
    doc = doc_of(bounds)
    order = sort_within(doc, h)
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with their number of documents, summed up over about _PENDING rows at a time."""
    held: list[np.ndarray] = []

    def sums() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            held.append(_terms(data, offsets)[1])
            if sum(map(len, held)) > _PENDING:
                yield sums()
    if held:
        yield sums()


def lexicon(docs: DataFrame, rare: float = RARE, common: float = COMMON, max_terms: int = MAX_TERMS) -> np.ndarray:
    """Sorted hashes of the terms in the band, at most max_terms."""
    small_batches(docs.sparkSession)
    n_docs = docs.count()
    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    inside = checkpointed(counts.filter(F.col("n").between(rare * n_docs, common * n_docs)))
    size = inside.count()
    if size > max_terms:  # few documents' worth of terms: the rare end moves in
        least = inside.approxQuantile("n", [1 - max_terms / size], 0.0)[0]
        inside = inside.filter(F.col("n") > least)
    return np.sort(inside.select("term").toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64))


class Fingerprints:
    """Fingerprints of some texts: dense signatures, level, and the signatures at its rates (0: no term)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, terms: np.ndarray, dense: int = DENSE, subsets: int = SUBSETS):
        doc, h = _terms(data, offsets)
        n = len(offsets) - 1
        keep = np.zeros(len(h), dtype=bool)
        if len(terms):
            keep = terms[np.minimum(np.searchsorted(terms, h), len(terms) - 1)] == h
        has = np.bincount(doc[keep], minlength=n) > 0
        keep |= ~has[doc]
        self.doc, self.h, self.n = doc[keep], h[keep], n
        self.own = mix(self.h + np.uint64(0x2545F4914F6CDD1D))
        m = np.bincount(self.doc, minlength=n)
        self.level = np.where(m > 0, np.frexp(np.maximum(m, 1))[1] - 1, -1).astype(np.int64)
        self.dense = np.zeros((n, dense), dtype=np.uint16)
        self.signs = np.zeros((n, RATES, subsets), dtype=np.uint16)
        for s in range(dense):
            draw = mix(self.h ^ np.uint64((0xD1B54A32D192ED03 * (s + 1)) % (1 << 64)))
            self.dense[:, s] = self._signature(np.flatnonzero(draw >> np.uint64(61)), s)
        least = (np.uint64(1) << (self.level + 1).astype(np.uint64)) - np.uint64(1)
        least = least[self.doc]
        for r in range(0, subsets, 2):
            both = mix(self.h + np.uint64((0x632BE59BD9B4E019 * (r + 1)) % (1 << 64)))
            for s in range(r, min(r + 2, subsets)):
                draw = both >> np.uint64(32) if s > r else both & np.uint64(0xFFFFFFFF)
                # A term lies in the subset at rate 2**-r if r low bits of its draw are 0.
                hit = np.flatnonzero((draw & least) == 0)
                for rate in range(RATES):
                    if rate:
                        deeper = (np.uint64(1) << (self.level[self.doc[hit]] + 1 + rate).astype(np.uint64)) - np.uint64(1)
                        hit = hit[(draw[hit] & deeper) == 0]
                    self.signs[:, rate, s] = self._signature(hit, dense + s)

    def _signature(self, hit: np.ndarray, salt: int) -> np.ndarray:
        """Per text a 16-bit hash of the sequence of its terms at ``hit``; 0 without any."""
        doc = self.doc[hit]
        bounds = np.searchsorted(doc, np.arange(self.n + 1))
        v = run_hash(prefix_sums(self.own[hit]), bounds[:-1], bounds[1:], salt)
        return np.where(bounds[1:] > bounds[:-1], v % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.uint16)

    def row(self, i: int) -> tuple[int, np.ndarray, np.ndarray]:
        return int(self.level[i]), self.dense[i], self.signs[i]


def as_text(row: tuple[int, np.ndarray, np.ndarray]) -> str:
    level, dense, signs = row
    return f"{level}:{dense.astype('>u2').tobytes().hex()}:{signs.astype('>u2').tobytes().hex()}" if level >= 0 else "-"


def likeness(one: tuple[int, np.ndarray, np.ndarray], two: tuple[int, np.ndarray, np.ndarray]) -> float:
    """Share of equal signatures among the subsets in which either has a term."""
    (a, dense_a, signs_a), (b, dense_b, signs_b) = one, two
    if a < 0 or b < 0:
        return float(a == b)
    rates = range(max(0, b - a), min(RATES, RATES + b - a))  # at rate x of the first stands rate x + a - b of the second
    left = np.concatenate([dense_a, *(signs_a[x] for x in rates)])
    right = np.concatenate([dense_b, *(signs_b[x + a - b] for x in rates)])
    used = (left > 0) | (right > 0)
    return float(np.mean(left[used] == right[used])) if used.any() else float(a == b and np.array_equal(signs_a, signs_b))


def dense_likeness(one: tuple[int, np.ndarray, np.ndarray], two: tuple[int, np.ndarray, np.ndarray]) -> float:
    """Share of equal signatures among the dense subsets alone, in which most terms of a text survive."""
    used = (one[1] > 0) | (two[1] > 0)
    return float(np.mean(one[1][used] == two[1][used])) if used.any() else float(one[0] < 0 and two[0] < 0)


def _rows_of(texts: list[str], terms: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for lo, hi, data, offsets in slices(pa.array(texts, pa.large_string()), _CHUNK):
        f = Fingerprints(data, offsets, terms)
        out += [f.row(i) for i in range(hi - lo)]
    return out


def fingerprint(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id and fingerprint of every text under a lexicon."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most MAX_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), _CHUNK):
                f = Fingerprints(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([as_text(f.row(i)) for i in range(hi - lo)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def _runs_of(place: np.ndarray, sums: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The run of each row; run k begins at the key cuts[k], of rows (place, sum) in order."""
    run = np.searchsorted(cuts[:, 0], place, "right") - 1
    first = np.searchsorted(cuts[:, 0], place, "left")
    for a, b in {(int(a), int(b)) for a, b in zip(first, run) if b >= a}:  # cuts at this very place: the sums decide
        here = (first == a) & (run == b)
        run[here] = a - 1 + np.searchsorted(cuts[a : b + 1, 1], sums[here], "right")
    return np.maximum(run, 0)


def _deal(cuts: np.ndarray):
    """Rows with their run, texts compressed; the row at which a run begins also ends the run before, as a sentinel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        heads = {(int(p), int(s)): k for k, (p, s) in enumerate(cuts)}
        for batch in batches:
            place, sums = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            packed = [pack.compress((t.as_py() or "").encode("utf-8")) for t in batch.column(3)]
            own = _runs_of(place, sums, cuts)
            also = [i for i, key in enumerate(zip(place.tolist(), sums.tolist())) if key in heads]
            before = [(heads[(int(place[i]), int(sums[i]))] - 1) % len(cuts) for i in also]
            which = pa.array([*range(len(own)), *also], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*own.tolist(), *before], pa.int32()),
                    pa.array([0] * len(own) + [1] * len(also), pa.int32()),
                    *[batch.column(c).take(which) for c in range(3)],
                    pa.array([*packed, *[packed[i] for i in also]], pa.binary()),
                ],
                names=["run", "sentinel", "place", "sum", "doc_id", "packed"],
            )

    return run


def _compare(shared):
    """Rows in order, each with the text of the next one; a sentinel ends a run and is not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        terms = shared.value
        held: list[tuple[int | None, bool, str]] = []
        known: list[tuple[int, np.ndarray, np.ndarray]] = []  # fingerprints of the first rows of ``held``

        def flush() -> Iterator[pa.RecordBatch]:
            known.extend(_rows_of([t for _, _, t in held[len(known) :]], terms))
            pairs = [k for k in range(len(held) - 1) if not held[k][1]]
            if pairs:
                edited = []
                for k in pairs:
                    half = len(held[k][2]) // 2
                    edited.append(held[k][2][: len(held[k][2]) - half] + held[k + 1][2][:half])
                other = _rows_of(edited, terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[k][0] for k in pairs], pa.int64()),
                        pa.array([len(held[k][2]) for k in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
                        pa.array([as_text(known[k]) for k in pairs]),
                        pa.array([as_text(o) for o in other]),
                        pa.array([likeness(known[k], o) for k, o in zip(pairs, other)], pa.float64()),
                        pa.array([likeness(known[k], known[k + 1]) for k in pairs], pa.float64()),
                        pa.array([dense_likeness(known[k], o) for k, o in zip(pairs, other)], pa.float64()),
                        pa.array([dense_likeness(known[k], known[k + 1]) for k in pairs], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "dense_edited", "dense_next"],
                )
            del held[:-1], known[:-1]

        size = 0
        for batch in batches:
            for sentinel, doc_id, packed in zip(batch.column(1), batch.column(4), batch.column(5)):
                sentinel = bool(sentinel.as_py())
                if sentinel and (not held or held[-1][1]):
                    continue  # a repeat of the row that ends the run
                text = unpack.decompress(packed.as_py()).decode("utf-8")
                held.append((doc_id.as_py(), sentinel, text))
                size += len(text)
                if size > _CHUNK:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def compare_edited(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    near_edited and near_next are likenesses over all subsets, dense_edited and dense_next those of the dense ones
    alone (the published method, which finds copies with few changes).

    The edited text has its last floor(n/2) code points replaced by the first as many of the next
    document's, in descending order of doc_id (null last; rows that share a doc_id in the order of
    their texts' hashes; after the last comes the first).  Rows that repeat both lie in one run.

    Documents are dealt into as many runs of neighbours as there are shuffle partitions.  A run begins
    at a row of a sample (16 keys a run reach the driver), so that this row can be sent to the run
    before as well when the texts are dealt, in the one shuffle that there is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.when(F.col("doc_id").isNull(), F.lit((1 << 63) - 1)).otherwise(F.bitwise_not(F.col("doc_id").cast("long"))).alias("place"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("sum"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    every = max(1, docs.count() // (16 * parts))
    key = F.struct("place", "sum")
    sampled = F.pmod(F.xxhash64("place", "sum"), F.lit(every)) == 0
    seen = rows.agg(F.min(key).alias("first"), F.collect_set(F.when(sampled, key)).alias("some")).first()
    keys = sorted({tuple(k) for k in [*([seen["first"]] if seen["first"] else []), *seen["some"]]})
    if not keys:
        keys = [(0, 0)]
    cuts = np.array(sorted({keys[0], *(keys[len(keys) * i // parts] for i in range(1, parts))}), dtype=np.int64).reshape(-1, 2)
    dealt = rows.mapInArrow(_deal(cuts), "run int, sentinel int, place long, sum long, doc_id long, packed binary")
    ordered = dealt.repartitionById(len(cuts), F.col("run")).sortWithinPartitions("run", "sentinel", "place", "sum")
    shared = spark.sparkContext.broadcast(terms)  # at most MAX_TERMS
    return ordered.mapInArrow(_compare(shared), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, dense_edited double, dense_next double")
