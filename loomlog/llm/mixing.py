"""Mixing sources to target weights, in DataFrame operations only.

Targets: each source gets its weight's share of the whole, clamped at ``max_epochs`` times what it
has; the excess goes to the others in proportion to their weights until none is above its clamp
(capped water-filling).  With the sources sorted by clamp over weight the clamped ones come first,
so one running sum over the table of sources (one row each, ordered in one task) gives the final
level without iteration.

Sampling: a source with rate r = target / size gives every document floor(r) times, and once more
to documents in the order of a seeded hash until the fraction is used up.  The hash at which that
ends is found with sums over ranges of the hash, 4,096 for each source, then again inside the range
in which the fraction ends, until that holds one hash: each step is one grouped sum, and no source
is ordered document by document.  The document in which it ends is repeated in part, by as many
words as are still missing; for whole documents only (``whole_only``), it joins if that brings the
sum nearer to the target.

Null sources form one source, last in order; null texts have size 0 and are taken floor(r) times,
which adds nothing.  Rows that repeat a doc_id, a text and a source share one hash; where the
fraction ends among them they are numbered, and each counts as a document of its own.  An empty
table gives an empty result.  Other columns may have any names; ``mixed_documents`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.cluster import checkpointed
from loomlog.llm.textops import WORD

_STEP = 12
_FEW_SOURCES = 1 << 16


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))


def cyclic_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, by rank from 1."""
    return ((rank - 1) % 3 + 1).cast("double")


def source_targets(sizes: DataFrame, weight=cyclic_weight, max_epochs: float = 3.0) -> DataFrame:
    """Per source: source, source_size, weight, target.  ``sizes``: source, source_size."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("weight", weight(F.row_number().over(by_name))).withColumn("clamp", F.col("source_size") * F.lit(max_epochs))
    order = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("clamped_before", F.coalesce(F.sum("clamp").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("clamped_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("is_clamped", F.col("clamp") <= F.col("weight") * F.col("level"))
    )
    level = F.min(F.when(~F.col("is_clamped"), F.struct((F.col("clamp") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("level").alias("level")))).over(everything)
    s = s.withColumn("final", level["level"])
    target = F.when(F.col("is_clamped"), F.col("clamp")).otherwise(F.col("weight") * F.col("final"))
    return s.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _edges(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """Per source with a fraction to take: of, edge (the hash at which it ends), edge_before (the sum below it)."""
    width = 64
    open_ = rates.filter("extra > 0").select("of", "extra", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"))
    while True:
        step = min(_STEP, width)
        width -= step
        inside = _by_source(sized, open_).filter(F.lit(width + step == 64) | (F.shiftright("row_hash", width + step) == F.col("low")))
        bins = inside.groupBy("of", "extra", "before", F.shiftright("row_hash", width).alias("bin")).agg(F.sum("size").alias("bin_size"), F.min("row_hash").alias("least"), F.max("row_hash").alias("most"))
        running = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("at", F.col("before") + F.coalesce(F.sum("bin_size").over(running), F.lit(0)))
        hit = bins.filter((F.col("at") < F.col("extra")) & (F.col("extra") <= F.col("at") + F.col("bin_size")))
        open_ = checkpointed(hit.select("of", "extra", F.col("bin").alias("low"), F.col("at").alias("before"), "least", "most"))
        if width == 0 or open_.filter("least < most").isEmpty():
            return open_.select("of", F.col("least").alias("edge"), F.col("before").alias("edge_before"))


def _by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the table's row for their source; broadcast while the sources are few."""
    if table.count() <= _FEW_SOURCES:
        table = F.broadcast(table)
    return rows.join(table, F.col("source").eqNullSafe(F.col("of")))


def _plan(sized: DataFrame, weight, max_epochs: float) -> DataFrame:
    """Per source: of, source_size, target, whole (copies of every document), extra, edge, edge_before."""
    targets = checkpointed(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weight, max_epochs))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs)))).otherwise(F.lit(0.0))
    # A rate that is whole but for rounding counts as whole.
    near = F.abs(rate - F.round(rate)) < 1e-9
    rates = targets.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.when(near, F.round(rate)).otherwise(F.floor(rate)).cast("int").alias("whole"),
        F.when(near, F.lit(0.0)).otherwise((rate - F.floor(rate)) * F.col("source_size")).alias("extra"),
    )
    edges = _edges(sized, rates)
    return checkpointed(rates.alias("r").join(edges.alias("e"), F.col("r.of").eqNullSafe(F.col("e.of")), "left").select("r.*", "edge", "edge_before"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of each source numbered from 0 as ``nth``: inside each task's share, after the shares before it."""
    rows = checkpointed(rows.withColumn("share", F.spark_partition_id()))
    within = Window.partitionBy("of", "share").orderBy("row_key")
    counts = rows.groupBy("of", "share").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("of").alias("of_"), F.col("share").alias("share_"), before.alias("offset"))
    joined = rows.withColumn("in_share", F.row_number().over(within) - 1).join(counts, F.col("of").eqNullSafe(F.col("of_")) & (F.col("share") == F.col("share_")))
    return joined.withColumn("nth", F.col("offset") + F.col("in_share"))


def _dealt(rows: DataFrame, plan: DataFrame, whole_only: bool, keep: list[str]) -> DataFrame:
    """``keep`` and source_size, target, repeats, taken of rows with source, size, row_hash, row_key."""
    joined = _by_source(rows, plan)
    at_edge = F.coalesce(F.col("row_hash") == F.col("edge"), F.lit(False))
    left = F.round(F.col("extra") - F.col("edge_before") - F.col("nth") * F.col("size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    edge = _numbered(joined.filter(at_edge)).withColumn("part", part)
    joins = 2 * F.col("part") >= F.col("size") if whole_only else F.col("part") >= F.col("size")
    # What has no words joins only where words are still missing.
    edge = edge.withColumn("once_more", (joins & ((F.col("size") > 0) | (left > 0))).cast("int"))
    if whole_only:
        edge = edge.withColumn("part", F.col("size") * F.col("once_more"))
    rest = joined.filter(~at_edge).withColumn("once_more", F.coalesce((F.col("row_hash") < F.col("edge")).cast("int"), F.lit(0)))
    rest = rest.withColumn("part", F.col("size") * F.col("once_more"))
    out = [*keep, "source_size", "target", (F.col("whole") + F.col("once_more")).alias("repeats"), (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken")]
    return rest.select(*out).unionByName(edge.select(*out))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(seed).alias("row_hash")))


def mix(docs: DataFrame, weight=cyclic_weight, max_epochs: float = 3.0, seed: int = 17, whole_only: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, repeats, taken.

    ``repeats`` is the number of whole copies that the mix takes, ``taken`` the number of words.
    """
    sized = _sized(docs, seed)
    rows = sized.withColumn("row_key", F.col("row_hash"))
    return _dealt(rows, _plan(sized, weight, max_epochs), whole_only, ["doc_id", "source", "size"])


def mixed_documents(docs: DataFrame, weight=cyclic_weight, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Rows are not shuffled: each is decided by its hash and its source's row of the plan.
    """
    plan = _plan(_sized(docs, seed), weight, max_epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), row_hash(seed).alias("row_hash"), F.xxhash64(row).alias("row_key"))
    taken = _dealt(rows, plan, True, ["row"]).filter("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")
