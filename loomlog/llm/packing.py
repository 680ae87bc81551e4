r"""Packing of documents into sequences by best-fit decreasing.

Every document is encoded and ends with one id more (``end``).  A document longer than the window is
first cut into full windows; what is left of it is one item, shorter than the window.  Best-fit
decreasing then takes the items from the longest to the shortest and puts each into the open window
with the least room that holds it, or into a new one.  Only the sizes of the items matter for that, and
there are fewer of them than the window has places: the driver gets one count for each size, and a segment
tree over remaining capacities holds how many windows are open at each.  Items of one size go to all windows of
a capacity at once, which leads to the same windows as one item after the other.  The plan says, for
each size, which ranks among its items go to which kind of window; it does not grow with the documents.
Each item finds its window from its rank by arithmetic.  Ranks are counted while documents are encoded, per task
and size, and the counts of the tasks before are added.

Items that no size complements would leave windows half empty (a million copies of one text, say).
So the emptiest windows are dissolved at the end: their items are cut to fill the others to the
brim, and what is then left, less than a window, becomes sequences whose lengths are powers of two,
which need no padding.  No sequence needs padding then.

Null texts count as empty, and an empty text is a document of one id.  Texts of any length are
encoded in slices.  Rows that repeat a doc_id, and a null doc_id, are documents like any other.  An empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.bpe import tables
from loomlog.llm.bpe_batch import encode_texts
from loomlog.llm.cluster import checkpointed, small_batches, stored

WINDOW = 2048
_MOST_BROADCAST = 500_000  # rows of offsets


class Capacities:
    """A segment tree over remaining capacities: how many windows are open at each."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.size
        while k:
            self.sums[k] += n
            k //= 2

    def tightest(self, least: int) -> int:
        """The least capacity of at least ``least`` at which a window is open, or -1."""
        k = least + self.size
        while not self.sums[k]:
            while k & 1:  # a right child: what is to its right hangs higher up
                k //= 2
            if not k:
                return -1
            k += 1
        while k < self.size:
            k = 2 * k if self.sums[2 * k] else 2 * k + 1
        return k - self.size


def best_fit(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of windows: how many there are, and the (size, number) of the items in each, in the order they came.

    counts: number of items of each size, all below or at the window.
    """
    open_: dict[int, list[tuple[int, tuple | None]]] = {}  # by room: windows, and their content as a linked list
    tree = Capacities(window)

    def put(room: int, n: int, content: tuple) -> None:
        open_.setdefault(room, []).append((n, content))
        tree.add(room, n)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = tree.tightest(size)
            n, content = (left, None) if room < 0 else open_[room].pop()
            room = window if room < 0 else room
            if content is not None:
                tree.add(room, -n)
            each = room // size  # the window stays the tightest until no more of them fit
            filled = min(n, left // each)
            if filled:
                put(room - each * size, filled, (content, size, each))
                left -= filled * each
                n -= filled
            if left < each and left and n:
                put(room - left * size, 1, (content, size, left))
                left, n = 0, n - 1
            if n and content is not None:
                put(room, n, content)
    out = []
    for room in sorted(open_):
        for n, content in open_[room]:
            items = []
            while content is not None:
                content, size, each = content
                items.append((size, each))
            out.append((n, items[::-1]))
    return out


class Plan:
    """Where items go: rows for the items of each size, and the gaps that cut items fill.

    rows: (size, low, high, each, window, inside, stream, used): the items of the size whose ranks are
    from low to below high stand in windows from number ``window`` on, ``each`` in one, beginning at ``inside``; or,
    where stream is not -1, their windows (``used`` ids long) lie one after another in the stream of ids
    that is cut.  gaps: (low, room, window, inside): from low on the stream fills windows from that number on,
    ``room`` ids in each, beginning at ``inside``.  sequences: how many there are.
    """

    def __init__(self, counts: dict[int, int], window: int = WINDOW):
        kinds = [(n, items, sum(s * k for s, k in items)) for n, items in best_fit(counts, window)]
        kinds.sort(key=lambda x: -x[2])  # fullest first
        keep, ids = 0, sum(n * used for n, _, used in kinds if used < window)
        full = sum(n for n, _, used in kinds if used == window)
        keep = full + ids // window  # as many windows as the ids can fill
        self.rows, self.gaps = [], []
        ranks = dict.fromkeys(counts, 0)
        number, stream, gap = 0, 0, 0
        for n, items, used in kinds:
            stay = min(n, max(0, keep - number))
            for m, cut in ((stay, False), (n - stay, True)):
                if not m:
                    continue
                inside = 0
                for size, each in items:
                    self.rows.append((size, ranks[size], ranks[size] + m * each, each, -1 if cut else number, inside, stream if cut else -1, used))
                    ranks[size] += m * each
                    inside += size * each
                if cut:
                    stream += m * used
                else:
                    if used < window:
                        self.gaps.append((gap, window - used, number, used))
                        gap += m * (window - used)
                    number += m
        rest = stream - gap
        while rest:
            part = 1 << (rest.bit_length() - 1)
            self.gaps.append((gap, part, number, 0))
            gap, rest, number = gap + part, rest - part, number + 1
        self.sequences = number


def _encode(path: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = tables(path), TaskContext.get().partitionId()
        ranks, full = [0] * window, 0
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, parts in encode_texts(t, texts):
                rows: list[tuple] = []
                for ids in parts:
                    raw = ids.tobytes() + last
                    n_full, size = divmod(len(raw) // 4, window)
                    rows.append((part, len(raw) // 4, full, n_full, size, ranks[size], raw))
                    full += n_full
                    ranks[size] += 1
                cols = list(zip(*rows))
                arrays = [batch.column(0).slice(lo, hi - lo), *(pa.array(c, kind) for c, kind in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", "doc_tokens", "full_before", "n_full", "size", "rank", "ids"])

    return run


def _longs(values: list[int]) -> Column:
    """The values as one folded literal."""
    return F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast("array<bigint>")


def _items(rows: DataFrame, window: int) -> tuple[DataFrame, Plan, int]:
    """rows with item (rank among all items of the size) and first_full (number of the document's first full window)."""
    sums = checkpointed(rows.groupBy("part", "size").agg(F.count("*").alias("n"), F.sum("n_full").alias("f")))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("item_offset"))
    by_part = sums.groupBy("part").agg(F.sum("f").alias("f"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task of the encoder
    by_part = by_part.select(F.col("part").alias("part_"), F.coalesce(F.sum("f").over(earlier), F.lit(0)).alias("full_offset"))
    offsets = checkpointed(offsets.join(by_part, F.col("part") == F.col("part_")).select(F.col("part").alias("p"), F.col("size").alias("s"), "item_offset", "full_offset"))
    counts = {r["size"]: r["n"] for r in sums.groupBy("size").agg(F.sum("n").alias("n")).collect() if r["size"]}  # fewer than the window
    n_full = sums.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    if offsets.count() <= _MOST_BROADCAST:
        offsets = F.broadcast(offsets)
    out = rows.join(offsets, (F.col("part") == F.col("p")) & (F.col("size") == F.col("s")))
    return out.withColumns({"item": F.col("rank") + F.col("item_offset"), "first_full": F.col("full_before") + F.col("full_offset")}), Plan(counts, window), n_full


def _cut(plan: Plan, x: Column, size: Column, start: Column, n_full: int) -> Column:
    """Pieces of an item that lies at x in the stream."""
    low, room, first, inside = (_longs([g[k] for g in plan.gaps]) for k in range(4))
    steps = F.lit([1 << b for b in reversed(range(max(1, len(plan.gaps)).bit_length()))])
    at = lambda table, k: F.get(table, k.cast("int"))
    find = lambda v: F.aggregate(steps, F.lit(0), lambda k, step: F.when(at(low, k + step) <= v, k + step).otherwise(k))
    end = x + size

    def of_kind(k: Column) -> Column:
        a, b = F.greatest(x, at(low, k)), F.least(end, F.coalesce(at(low, k + 1), end))
        number = lambda v: F.floor((v - at(low, k)) / at(room, k))

        def piece(w: Column) -> Column:
            begin = at(low, k) + w * at(room, k)
            lo, hi = F.greatest(a, begin), F.least(b, begin + at(room, k))
            return _piece(start + lo - x, hi - lo, at(first, k) + w + F.lit(n_full), at(inside, k) + lo - begin)

        return F.transform(F.sequence(number(a), number(b - 1)), piece)

    return F.flatten(F.transform(F.sequence(find(x), find(end - 1)), of_kind))


def _piece(start: Column, length: Column, sequence: Column, offset: Column) -> Column:
    return F.struct(*[c.cast("long").alias(n) for c, n in ((start, "start"), (length, "length"), (sequence, "sequence_id"), (offset, "offset"))])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    docs: doc_id, text.  ids: the piece's token ids as little-endian unsigned 32-bit integers.  The ids of a
    sequence are those of its pieces in the order of offset; sequences are numbered without gaps, full windows first.
    """
    small_batches(docs.sparkSession)
    read = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    schema = "doc_id bigint, part int, doc_tokens bigint, full_before bigint, n_full bigint, size int, rank bigint, ids binary"
    rows = stored(read.mapInArrow(_encode(tokenizer, window, end), schema), "tokens")
    items, plan, n_full = _items(rows, window)
    spark = docs.sparkSession
    names = "p_size int, low long, high long, each long, window long, inside long, stream long, used long"
    # At most one row for a size and kind of window: a few thousand kinds, of at most 63 sizes each.
    placed = items.join(F.broadcast(spark.createDataFrame(plan.rows, names)), (F.col("size") == F.col("p_size")) & (F.col("item") >= F.col("low")) & (F.col("item") < F.col("high")), "left")
    place = F.col("item") - F.col("low")
    nth, size = F.floor(place / F.col("each")), F.col("size").cast("long")
    inside = F.col("inside") + (place % F.col("each")) * size
    start = F.col("n_full") * window
    whole = F.array(_piece(start, size, F.col("window") + nth + F.lit(n_full), inside))
    cut = _cut(plan, F.col("stream") + nth * F.col("used") + inside, size, start, n_full)
    of_full = lambda k: _piece(k * window, F.lit(window), F.col("first_full") + k, F.lit(0))
    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    full = F.when(F.col("n_full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_full") - 1), of_full)).otherwise(none)
    rest = F.when(F.col("size") == 0, none).when(F.col("stream") < 0, whole).otherwise(cut) if plan.gaps else F.when(F.col("size") == 0, none).otherwise(whole)
    pieces = placed.select("doc_id", "doc_tokens", "ids", F.explode(F.concat(full, rest)).alias("x")).select("doc_id", "doc_tokens", "ids", "x.*")
    own = F.substr("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return pieces.select("doc_id", "start", "length", own.alias("ids"), "doc_tokens", "sequence_id", "offset")
