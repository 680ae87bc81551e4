r"""Filter interaction audit: what five quality filters remove in each of their 120 orders.

The texts are scanned in Arrow buffers.  Byte classes (capitals, symbols, bytes that continue a code
point) are looked up for a piece of a buffer at once, and prefix sums give each document's counts.
Words are hashed; a document's hashes are sorted, equal neighbours are compared byte by byte, and what
starts a run counts as distinct.  A document whose hashes collide is counted by its words themselves.
The failures of a document become the bits of a mask, so that all orders follow from the number of
documents with each mask: at most 32 for each part, whatever the number of documents.

The filters, by what makes a document fail (``FILTERS`` gives the limits):
A fewer than 200 words; B fewer distinct words than half of the words; C capitals above 3 % of the code
points; D any of ``#$%&*|``; E its text is that of a smaller doc_id anywhere in the table.

Texts are equal if their SHA-256 is.  Null texts count as empty: they fail A only, and E if they are not
the first.  A null lang is the part ''.  A null doc_id comes after all others, so such a row fails E if a
row with a doc_id has its text, and it has no labels.  Rows that repeat a doc_id are separate documents, none
smaller than the other.  Labels that repeat a doc_id count together: quality or toxic is 1 if any is.  An
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.cluster import small_batches, stored
from loomlog.llm.textops import doc_of, hash_words, slices, sort_within

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
_PIECE = 1 << 18

_CAPITAL, _SYMBOL, _CONTINUES = (np.zeros(256, dtype=bool) for _ in range(3))
_CAPITAL[65:91] = True
_SYMBOL[list(SYMBOLS)] = True
_CONTINUES[128:192] = True


def class_counts(data: np.ndarray, offsets: np.ndarray, of_class: np.ndarray) -> np.ndarray:
    """How many bytes of a class each text has; a piece of the buffer at a time."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    for lo in range(0, len(data), _PIECE):
        hi = min(lo + _PIECE, len(data))
        sums = np.zeros(hi - lo + 1, dtype=np.int64)
        np.cumsum(of_class[data[lo:hi]], out=sums[1:])
        first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
        edges = np.clip(offsets[first : last + 1], lo, hi) - lo
        out[first:last] += np.diff(sums[edges])
    return out


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words of ``size`` bytes at a and at b are equal."""
    out = np.ones(len(a), dtype=bool)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PIECE, "right")))
        n = size[lo:hi]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = data[np.repeat(a[lo:hi], n) + within] != data[np.repeat(b[lo:hi], n) + within]
        out[lo + np.repeat(np.arange(hi - lo), n)[differs]] = False
        lo = hi
    return out


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each text."""
    h, starts, ends, bounds = hash_words(data, offsets)
    words, doc = np.diff(bounds), doc_of(bounds)
    order = sort_within(doc, h)
    doc, h, starts, size = doc[order], h[order], starts[order], (ends - starts)[order]
    again = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1])) + 1
    distinct = words - np.bincount(doc[again], minlength=len(words))
    wrong = size[again] != size[again - 1]
    right = again[~wrong]
    wrong[~wrong] = ~_same_bytes(data, starts[right], starts[right - 1], size[right])
    for k in np.unique(doc[again[wrong]]):
        distinct[k] = len(set(bytes(data[offsets[k] : offsets[k + 1]]).split()))
    return words, distinct


def text_masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 of each text: whether it fails A, B, C, D."""
    words, distinct = distinct_words(data, offsets)
    points = np.diff(offsets) - class_counts(data, offsets, _CONTINUES)
    fails = (
        words < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT_PERCENT * words,
        100 * class_counts(data, offsets, _CAPITAL) > MOST_CAPITALS_PERCENT * points,
        class_counts(data, offsets, _SYMBOL) > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(3)):
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(text_masks(data, offsets), pa.int32())], names=["doc_id", "part", "digest", "mask"])


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row of docs (doc_id, text, lang): bit k is set if the row fails filter k."""
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = stored(read.mapInArrow(_scan, "doc_id bigint, part string, digest binary, mask int"), "masks")
    # Written before its join, so that Spark can split the rows of a text that very many documents have.
    firsts = stored(rows.groupBy(F.col("digest").alias("of")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1").select("of", "first_id"), "first_texts")
    copy = F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id")))
    return rows.join(firsts, F.col("digest") == F.col("of"), "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents with each mask, and how many of them are labelled so."""
    bit = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = stored(labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(bit("quality").alias("good"), bit("toxic").alias("toxic")).filter("good = 1 OR toxic = 1"), "marks")
    both = masks.join(marks, F.col("doc_id") == F.col("of"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good").alias("good"), total("toxic").alias("toxic"))


def order_steps() -> list[tuple[str, int, int, int]]:
    """Order, step, bit of the filter at the step, and the mask of those before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, own, before))
            before |= own
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic.  Returns part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    counts = mask_counts(failure_masks(docs), labels)
    steps = F.from_json(F.lit("[" + ",".join('{"o":"%s","s":%d,"f":%d,"b":%d}' % x for x in order_steps()) + "]"), "array<struct<o:string,s:int,f:int,b:int>>")
    rows = counts.select("*", F.explode(steps).alias("x"))  # at most 32 rows of a part, 600 steps each
    mask, own, before = F.col("mask"), F.col("x.f"), F.col("x.b")
    fails, open_ = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) == 0
    total = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")
    out = rows.groupBy("part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), own.alias("own")).agg(
        total(open_ & ~fails).alias("kept"),
        total(open_ & fails).alias("removed"),
        total(~open_ & fails).alias("redundant"),
        total(mask == own).alias("unique_fails"),
        total(open_ & fails, "good").alias("good_lost"),
        total(open_ & fails, "toxic").alias("toxic_lost"),
    )
    shares = out.groupBy(F.col("part").alias("of_part"), F.col("own").alias("of_own")).agg(F.sum("removed").cast("long").alias("shapley"))
    return out.join(shares, (F.col("part") == F.col("of_part")) & (F.col("own") == F.col("of_own"))).drop("own", "of_part", "of_own")
