"""Substring dedup by seed and extend.

Every window of ``length`` words picks the least k-gram hash in it (the rightmost of equals) as its
anchor, so equal windows share an anchor at the same place (winnowing).  An anchor is extended both
ways to the run of all windows that picked it; the hash of that run is its context.

1. Per anchor hash the documents are joined through one grouped row: number of occurrences, least
   and greatest context, first document.
2. Where all contexts of an anchor agree, the whole extended match repeats: every document but the
   first loses all windows of that run.
3. Where contexts differ, the repeat ends inside the run, and its windows are compared one by one
   (96-bit hashes) through the least document that holds each.
4. Repeats inside one document are found in that document alone.

Per document the covered windows are united, which yields the maximal repeats of at least
``length`` words.  No step pairs the members of a group with one another; groups meet in sums that
Spark aggregates before the shuffle, and the joins back are plain equi-joins that it can split.

Documents are ordered by doc_id; null comes before all ids, and rows with one doc_id have equal
rank (neither removes from the other).  (If null, the least and the greatest 64-bit id all occur,
the least one counts as null.)  Null and empty texts have no words; texts may have any
length; an empty table gives an empty result.  Other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.cluster import small_batches
from loomlog.llm.textops import hash_words, prefix_sums, run_hash, slices

_NULL_ID = -(1 << 63)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Runs:
    """Anchored runs of the windows of some texts: texts, first and last window, anchor, context."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, length: int, k: int):
        self.bounds, self.length = bounds, length
        self.acc = prefix_sums(hashes)
        n, w = len(hashes), length - k + 1
        size = np.diff(bounds)
        windows = np.maximum(size - length + 1, 0)
        doc = np.repeat(np.arange(len(size)), windows)
        self.window = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + bounds[:-1][doc]
        self.doc = doc
        if not len(doc):
            self.first = self.last = self.run_doc = np.zeros(0, np.int64)
            self.anchor = self.context = np.zeros(0, np.uint64)
            return
        at = np.arange(max(n - k + 1, 0))
        grams = np.full(n, _MAX, dtype=np.uint64)
        grams[: len(at)] = run_hash(self.acc, at, at + k, salt=1)
        best, where = grams.copy(), np.arange(n)
        span = 1
        while span < w:  # least of the next w k-grams by doubling; of equals the rightmost
            step = min(span, w - span)
            right, right_at = best[step:], where[step:]
            take = right <= best[: n - step]
            best[: n - step] = np.where(take, right, best[: n - step])
            where[: n - step] = np.where(take, right_at, where[: n - step])
            span += step
        anchor_at = where[self.window]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(doc)) - 1
        self.first, self.last, self.run_doc = self.window[begin], self.window[end], doc[begin]
        self.anchor = grams[anchor_at[begin]]
        lead = (anchor_at[begin] - self.first).astype(np.uint64)
        self.context = run_hash(self.acc, self.first, self.last + length, salt=2) + lead

    def window_hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return run_hash(self.acc, starts, starts + self.length, 3), _second(self.acc, starts, self.length)


def _second(acc: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """An independent hash of a window: its two halves, joined otherwise."""
    mid = starts + length // 2
    return run_hash(acc, starts, mid, 4) * np.uint64(0x9FB21C651E98DF25) + run_hash(acc, mid, starts + length, 5)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Marks the first row of each distinct key; rows come in order of position."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        same = np.ones(len(order) - 1, dtype=bool)
        for key in keys:
            same &= key[order[1:]] == key[order[:-1]]
        new[1:] = ~same
    out = np.zeros(len(order), dtype=bool)
    out[order] = new  # lexsort is stable: the first of equals is the earliest
    return out


def _anchor_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in slices(batch.column(2)):
                hashes, _, _, bounds = hash_words(data, offsets)
                runs = _Runs(hashes, bounds, length, k)
                keep = _first_of(runs.run_doc, runs.anchor, runs.context)
                doc = runs.run_doc[keep]
                begin = runs.first[keep] - bounds[doc]
                yield pa.RecordBatch.from_arrays(
                    [_signed(runs.anchor[keep]), _signed(runs.context[keep]), pa.array(ids[lo:hi][doc]), pa.array(sums[lo:hi][doc]), pa.array(begin.astype(np.int32))],
                    names=["anchor", "context", "id", "sum", "at"],
                )

    return run


def _window_rows(length: int, k: int):
    """The distinct windows of the runs that begin at the listed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            for lo, hi, data, offsets in slices(batch.column(2)):
                hashes, _, _, bounds = hash_words(data, offsets)
                runs = _Runs(hashes, bounds, length, k)
                wanted = _wanted(runs, lists, lo, hi)
                starts = _spread(runs.first[wanted], runs.last[wanted])
                doc = np.repeat(runs.run_doc[wanted], runs.last[wanted] - runs.first[wanted] + 1)
                one, two = runs.window_hashes(starts)
                keep = _first_of(doc, one, two)
                doc = doc[keep]
                yield pa.RecordBatch.from_arrays(
                    [_signed(one[keep]), pa.array((two[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[lo:hi][doc]), pa.array(sums[lo:hi][doc]), pa.array((starts[keep] - bounds[doc]).astype(np.int32))],
                    names=["one", "two", "id", "sum", "at"],
                )

    return run


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    n = last - first + 1
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _wanted(runs: _Runs, lists: pa.Array, lo: int, hi: int) -> np.ndarray:
    """Indices of the runs whose first words are listed for their texts."""
    part = lists.slice(lo, hi - lo)
    size = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(hi - lo), size)
    return np.flatnonzero(np.isin(runs.first, flat + runs.bounds[doc]))


def _results(length: int, k: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, whole, single = batch.column(0), batch.column(3), batch.column(4)
            for lo, hi, data, offsets in slices(batch.column(2)):
                hashes, begin, end, bounds = hash_words(data, offsets)
                runs = _Runs(hashes, bounds, length, k)
                cover = np.zeros(len(hashes) + 1, dtype=np.int32)
                w = _wanted(runs, whole, lo, hi)
                np.add.at(cover, runs.first[w], 1)
                np.add.at(cover, np.minimum(runs.last[w] + length, len(hashes)), -1)
                part = single.slice(lo, hi - lo)
                size = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                starts = flat + bounds[np.repeat(np.arange(hi - lo), size)]
                one, two = runs.window_hashes(runs.window)
                again = runs.window[~_first_of(runs.doc, one, two)]
                starts = np.concatenate([starts, again])
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                raw = data.tobytes()
                n_words, n_gone, digests, texts = [], [], [], []
                removed = np.concatenate([[0], np.cumsum(gone)])
                for d in range(hi - lo):
                    a, b = int(bounds[d]), int(bounds[d + 1])
                    keep = np.flatnonzero(~gone[a:b]) + a
                    kept = b" ".join([raw[s:e] for s, e in zip(begin[keep].tolist(), end[keep].tolist())])
                    n_words.append(b - a)
                    n_gone.append(int(removed[b] - removed[a]))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode("utf-8"))
                spans = [_span_list(gone[int(bounds[d]) : int(bounds[d + 1])]) for d in range(hi - lo)]
                arrays = [ids.slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.int32()))]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]
                if with_text:
                    arrays.append(pa.array(texts, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _span_list(gone: np.ndarray) -> list[int]:
    """Begin and end of each maximal removed run, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return edge.tolist()


def substring_dedup(docs: DataFrame, length: int = 20, k: int = 6, with_text: bool = True) -> DataFrame:
    """Remove words covered by a window of ``length`` words that also starts earlier.

    docs: doc_id, text (others are ignored).  Returns doc_id, n_words, n_removed, kept_sha256,
    removed (begin and end word of each maximal repeat, flattened) and, with ``with_text``,
    kept_text.  One row per input row.
    """
    if not 1 <= k <= length:
        raise ValueError("k must lie between 1 and length")
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    ends = docs.agg(F.min(doc_id), F.max(doc_id), F.count_if(doc_id.isNull())).first()
    # The stand-in for null is the least number; if that is an id, all ids move up by one.
    shift = int(ends[2] > 0 and ends[0] == _NULL_ID and ends[1] < -_NULL_ID - 1)
    shown = F.when(F.col("id") != _NULL_ID, F.col("id") - shift) if ends[2] else F.col("id")
    rows = docs.select(
        F.coalesce(doc_id + shift, F.lit(_NULL_ID)).alias("id"),
        F.hash(F.coalesce("text", F.lit(""))).alias("sum"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    anchors = rows.mapInArrow(_anchor_rows(length, k), "anchor long, context long, id long, sum int, at int")
    groups = (
        anchors.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"), F.min("id").alias("first_id"))
        .filter("n > 1")
        .select(F.col("anchor").alias("group"), (F.col("lo") == F.col("hi")).alias("agree"), "first_id")
    )
    hits = anchors.drop("context").join(groups, F.col("anchor") == F.col("group")).filter("NOT agree OR id > first_id").select("id", "sum", "at", "agree")
    lists = hits.groupBy("id", "sum").agg(F.collect_list(F.when(F.col("agree"), F.col("at"))).alias("whole"), F.collect_list(F.when(~F.col("agree"), F.col("at"))).alias("open"))
    windows = (
        rows.join(lists.filter("size(open) > 0").select("id", "sum", "open"), ["id", "sum"])
        .select("id", "sum", "text", "open")
        .mapInArrow(_window_rows(length, k), "one long, two int, id long, sum int, at int")
    )
    firsts = windows.groupBy("one", "two").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1").select(F.col("one").alias("g1"), F.col("two").alias("g2"), "first_id")
    late = windows.join(firsts, (F.col("one") == F.col("g1")) & (F.col("two") == F.col("g2"))).filter("id > first_id").groupBy("id", "sum").agg(F.collect_list("at").alias("single"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<int>" + (", kept_text string" if with_text else "")
    out = (
        rows.join(lists.select("id", "sum", "whole"), ["id", "sum"], "left")
        .join(late, ["id", "sum"], "left")
        .select(shown.alias("doc_id"), "sum", "text", "whole", "single")
        .mapInArrow(_results(length, k, with_text), schema)
    )
    return out
