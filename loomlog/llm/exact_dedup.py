"""Exact dedup over a normalised text.

Rows are grouped by the 128-bit MD5 of the text without white space.  One pass over the texts stores
a short row for each document (id, length, hashes, a sequence number); groups are counted and their
winners found from those.  Then bytes are compared inside each group of more than one row: the least
and the greatest text of a group are equal exactly if all are.  Only rows that may belong to such a
group (a bounded bitmap of their ids) send their texts to that comparison, and Spark merges equal
texts before the shuffle, so a group that holds a third of all rows sends one row per map task.  A
group whose texts differ is a collision and is grouped again by the texts themselves, so that the
result is exact whatever the hash does.

The row with the most code points stays, then the smallest doc_id (null after all others), then the
first in the order of the stored rows: of rows that repeat a doc_id and a text exactly one stays.
Null texts count as empty, and all texts without words form one group.  An empty table gives an empty
result.  Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.bitset import BitSet
from loomlog.llm.cluster import checkpointed

_DELETED = " \t\n\v\f\r"


def without_space(text: Column) -> Column:
    """The text with every one of the six ASCII white-space characters deleted."""
    out = F.coalesce(text, F.lit(""))
    for c in _DELETED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _length(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit(""))).cast("long")


def _winners(rows: DataFrame, *keys: str) -> DataFrame:
    order = F.struct((-F.col("length")).alias("length"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "seq")
    return rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.min(order).alias("best"))


def _judged(docs: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    """Per input row: doc_id, length, hash, text_sha256, keep_id, group_size, kept."""
    norm = without_space(F.col("text"))
    # Stored once: the sequence numbers below are those of the stored rows.
    rows = checkpointed(
        docs.select(F.col("doc_id").alias("doc_id"), _length(F.col("text")).alias("length"), norm.alias("norm"))
        .select("doc_id", "length", content_hash(F.col("norm")).alias("hash"), F.sha2("norm", 256).alias("text_sha256"))
        .withColumn("seq", F.monotonically_increasing_id())
    )
    judged = checkpointed(_decided(rows, "hash"))
    copies = judged.filter("group_size > 1").select(F.xxhash64("doc_id").alias("id_hash"))
    texts = docs.select("doc_id", "text")
    maybe = BitSet(copies, "id_hash").part(texts, F.xxhash64("doc_id"), True).select("doc_id", norm.alias("norm")).select("doc_id", "norm", content_hash(F.col("norm")).alias("hash"))
    clashes = checkpointed(maybe.groupBy("hash").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest")).filter("least <> greatest").select(F.col("hash").alias("of")))
    if clashes.isEmpty():
        return judged
    # Different texts under one hash: the texts decide, each known by its SHA-256.
    apart = rows.join(clashes, F.col("hash") == F.col("of"), "left_semi")
    return judged.join(clashes, F.col("hash") == F.col("of"), "left_anti").unionByName(_decided(apart, "hash", "text_sha256").select(judged.columns))


def _decided(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with their group's size and winner.

    The winners of groups of several rows are stored first, so that Spark can split a group that
    holds many of the rows in the join.
    """
    several = checkpointed(_winners(rows, *keys).filter("group_size > 1"))
    both = rows.join(several, list(keys), "left")
    best = F.col("best")
    alone = best.isNull()
    return both.select(
        "doc_id",
        "length",
        "hash",
        "text_sha256",
        F.when(alone, F.col("doc_id")).otherwise(best["doc_id"]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("seq") == best["seq"])).alias("kept"),
    )


def exact_groups(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, length."""
    return _judged(docs, content_hash).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "length")


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Rows whose doc_id surely has no dropped row pass without a shuffle; the others are matched by
    doc_id, length and digest, so that a large group is dealt over many tasks.
    """
    judged = _judged(docs, content_hash).select("doc_id", "length", "text_sha256", "kept")
    dropped = judged.filter("NOT kept")
    if dropped.isEmpty():
        return docs
    known = BitSet(dropped.select(F.xxhash64("doc_id").alias("id_hash")), "id_hash")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    wrapped = docs.select(row.alias("row"))
    key = F.xxhash64("row.doc_id")
    passed = known.part(wrapped, key, False).select("row.*")
    suspects = known.part(wrapped, key, True).select(
        "row",
        F.col("row.doc_id").isNull().alias("k_null"),
        F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).alias("k_id"),
        _length(F.col("row.text")).alias("k_length"),
        F.sha2(without_space(F.col("row.text")), 256).alias("k_sha"),
    )
    on = ["k_null", "k_id", "k_length", "k_sha"]
    # Rows with one key repeat an id and a text; at most one of them stays.
    fate = (
        known.part(judged, F.xxhash64("doc_id"), True)
        .select(F.col("doc_id").isNull().alias("k_null"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k_id"), F.col("length").alias("k_length"), F.col("text_sha256").alias("k_sha"), "kept")
        .groupBy(*on)
        .agg(F.count("*").alias("rows"), F.max("kept").alias("one"))
        .filter("one")
    )
    alive = suspects.join(fate, on)
    single = alive.filter("rows = 1").select("row.*")
    repeated = alive.filter("rows > 1").groupBy(*on).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return passed.unionByName(single).unionByName(repeated)
