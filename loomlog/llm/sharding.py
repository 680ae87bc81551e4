"""K-d tree sharding, in DataFrame operations only.

The table is split again and again at a weighted median along the dimension in which the node's
rows are spread widest, until every leaf holds the target bytes: the whole divided by the number of
shards.  A node that has to make m shards splits in the ratio floor(m/2) to ceil(m/2).

Each dimension is put on a grid of 2**20 cells over the whole table.  A row's key in a dimension is
its cell and then 43 bits of a hash of its text, so rows with equal texts have equal keys (where the
dimensions depend on the text alone, as the default ones do) and no cut parts them.  Only a group of
equal texts that outweighs ``heavy`` of a shard has the lower half of those bits from a hash of the
row instead, so that it can be cut where balance needs it; there are at most shards / heavy such groups.

The median of a key is found with histograms of 4,096 bins for all nodes of a level at once, each a
grouped sum over the rows whose bin is still open; the driver receives one bin a node.  The tree is
three arrays (dimension, cut, next node), by which each row finds its leaf in as many steps as the tree has
levels.

Null texts have no bytes; null metadata lie below all values.  Rows that repeat a doc_id are separate
rows.  An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.cluster import checkpointed

_CELL, _HIGH, _LOW = 20, 22, 21
_KEY = _CELL + _HIGH + _LOW
_STEP = 12
_FIXED = 8


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def string_place(value: Column) -> Column:
    """A number that orders strings by their first six bytes."""
    head = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def default_dims() -> dict[str, Column]:
    """Length of the text, characters per byte and spaces per byte; equal texts have equal ones."""
    size = F.greatest(F.octet_length("text"), F.lit(1))
    spaces = F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))
    return {"length": F.log2(text_bytes(F.col("text")).cast("double") + 1), "density": F.char_length("text") / size, "spaces": spaces / size}


class _Tree:
    """Nodes numbered as they come; node 0 is the root."""

    def __init__(self, shards: int):
        self.shards, self.first = [shards], [0]
        self.dim, self.cut, self.left = [0], [0], [-1]

    def leaves(self) -> list[int]:
        return [k for k, left in enumerate(self.left) if left < 0 and self.shards[k] > 1]

    def split(self, k: int, dim: int, cut: int) -> None:
        half = self.shards[k] // 2
        self.dim[k], self.cut[k], self.left[k] = dim, cut, len(self.left)
        for shards, first in ((half, self.first[k]), (self.shards[k] - half, self.first[k] + half)):
            self.shards.append(shards)
            self.first.append(first)
            self.dim.append(0)
            self.cut.append(0)
            self.left.append(-1)

    def node_of(self, levels: int) -> Column:
        """The node at which a row with the array ``key`` arrives after that many steps."""
        dim, cut, left = (F.lit(x) for x in (self.dim, self.cut, self.left))
        at = lambda table, node: F.get(table, node)
        right = lambda node: (F.get("key", at(dim, node)) >= at(cut, node)).cast("int")
        step = lambda node, _: F.when(at(left, node) < 0, node).otherwise(at(left, node) + right(node))
        return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), F.lit(0), step)


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>")


def _medians(rows: DataFrame, tree: _Tree, dims: dict[int, int], tolerance: float) -> dict[int, int]:
    """Where each node is to be cut, by histograms that get finer until a bin is light."""
    cuts: dict[int, int] = {}
    low, width, below, goal = (dict.fromkeys(dims, v) for v in (0, _KEY, 0, None))
    while todo := [k for k in dims if k not in cuts]:
        slot = {k: i for i, k in enumerate(todo)}
        slots = F.lit([slot.get(k, -1) for k in range(len(tree.left))])
        shift = [max(width[k] - _STEP, 0) for k in todo]
        of = lambda values: F.get(_longs(values), F.col("slot"))
        inside = (
            rows.withColumn("slot", F.get(slots, F.col("node")))
            .filter("slot >= 0")
            .withColumn("k", F.get("key", of([dims[k] for k in todo]).cast("int")) - of([low[k] for k in todo]))
            .filter((F.col("k") >= 0) & (F.col("k") <= of([(1 << width[k]) - 1 for k in todo])))
        )
        bin_ = F.call_function("shiftright", F.col("k"), of(shift).cast("int"))
        bins = inside.groupBy("slot", bin_.alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("k").alias("least"), F.max("k").alias("most"))
        bins = bins.withColumn("upto", F.sum("bytes").over(Window.partitionBy("slot").orderBy("bin"))).withColumn("total", F.sum("bytes").over(Window.partitionBy("slot")))
        share = F.get(F.lit([tree.shards[k] // 2 / tree.shards[k] for k in todo]), F.col("slot"))
        known = F.get(F.lit([float(-1 if goal[k] is None else goal[k]) for k in todo]), F.col("slot"))
        bins = bins.withColumn("goal", F.when(known >= 0, known).otherwise(F.col("total") * share))
        hit = bins.filter(of([below[k] for k in todo]) + F.col("upto") >= F.col("goal"))
        found = {r["slot"]: r["b"] for r in hit.groupBy("slot").agg(F.min(F.struct("bin", "bytes", "rows", "upto", "goal", "least", "most")).alias("b")).collect()}
        for i, k in enumerate(todo):
            if i not in found:  # an empty node: nothing to cut
                cuts[k] = 0
                continue
            b = found[i]
            start, before, goal[k] = low[k] + (b["bin"] << shift[i]), below[k] + b["upto"] - b["bytes"], b["goal"]
            if b["least"] == b["most"] or b["bytes"] <= tolerance or shift[i] == 0:
                nearer_below = goal[k] - before <= before + b["bytes"] - goal[k]
                cuts[k] = low[k] + (b["least"] if nearer_below else b["most"] + 1)
            else:
                low[k], width[k], below[k] = start, shift[i], before
    return cuts


def kd_shards(docs: DataFrame, shards: int = 24, dims: dict[str, Column] | None = None, rows_per_run: int = 100_000, heavy: float = 0.25) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot.

    size is the text's bytes plus 8; slots are gapless from 0 in each shard, in the order of the
    rows' hashes.  dims: numeric metadata expressions; those that differ between rows of equal text
    can part them.
    """
    names = list(dims := default_dims() if dims is None else dims)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    base = checkpointed(
        docs.select(
            "doc_id",
            (text_bytes(F.col("text")) + F.lit(_FIXED)).alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
            text_hash.alias("text_hash"),
            F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).alias("row_hash"),
            *[c.cast("double").alias(f"dim_{k}") for k, c in dims.items()],
        )
    )
    stats = base.agg(F.sum("size").alias("total"), F.count("*").alias("n"), *[f(f"dim_{k}").alias(f"{t}_{k}") for k in names for f, t in ((F.min, "lo"), (F.max, "hi"))]).first()
    target, count = (stats["total"] or 0) / shards, stats["n"]
    groups = base.groupBy("text_hash").agg(F.sum("size").alias("weight")).filter(F.col("weight") > heavy * target)
    cells = (1 << _CELL) - 1

    def key(k: str) -> Column:
        lo, hi = stats[f"lo_{k}"], stats[f"hi_{k}"]
        cell = F.lit(0).cast("long") if lo is None or hi <= lo else F.coalesce(F.floor((F.col(f"dim_{k}") - F.lit(lo)) / F.lit(hi - lo) * F.lit(cells - 1)) + 1, F.lit(0)).cast("long")
        low = F.when(F.col("weight").isNull(), F.shiftrightunsigned(F.shiftleft("text_hash", _HIGH), 64 - _LOW)).otherwise(F.shiftrightunsigned("row_hash", 64 - _LOW))
        return F.shiftleft(cell, _HIGH + _LOW) + F.shiftleft(F.shiftrightunsigned("text_hash", 64 - _HIGH), _LOW) + low

    weighed = base.join(F.broadcast(groups), "text_hash", "left")  # at most shards / heavy groups
    keyed = checkpointed(weighed.select("doc_id", "size", "text_crc32", "row_hash", F.array(*[key(k) for k in names]).alias("key")))
    tree, levels = _Tree(shards), 0
    while count and (open_ := tree.leaves()):
        rows = keyed.select("size", "key", tree.node_of(levels).alias("node"))
        cell = lambda i: F.shiftright(F.col("key")[i], _HIGH + _LOW)
        spans = rows.groupBy("node").agg(*[(F.max(cell(i)) - F.min(cell(i))).alias(f"s{i}") for i in range(len(names))]).collect()
        dims_of = dict.fromkeys(open_, 0) | {r["node"]: max(range(len(names)), key=lambda i: r[f"s{i}"]) for r in spans if tree.shards[r["node"]] > 1}
        for k, cut in _medians(rows, tree, dims_of, 0.002 * target).items():
            tree.split(k, dims_of[k], cut)
        levels += 1
    placed = keyed.withColumn("shard", F.get(F.lit(tree.first), tree.node_of(levels))).select("doc_id", "size", "text_crc32", "row_hash", "shard")
    runs = max(1, -(-count // (shards * rows_per_run)))
    placed = placed.withColumn("run", F.pmod("row_hash", F.lit(runs)).cast("int"))
    sums = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("shard").alias("s"), F.col("run").alias("r"), "offset")
    order = Window.partitionBy("shard", "run").orderBy("row_hash", "doc_id")
    slotted = placed.withColumn("within", F.row_number().over(order) - 1)
    return slotted.join(offsets, (F.col("shard") == F.col("s")) & (F.col("run") == F.col("r"))).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"))
