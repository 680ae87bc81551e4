"""One long source in many tasks: rows are dealt in chunks of places, and borders are passed on.

A chunk is a range of places (line_idx or ord) of one source.  What a row needs from other chunks is
either a state at the chunk's begin, which follows from one summary row per chunk (a scan over
summaries, not over rows), or a few neighbouring rows, which come as a column of one row per chunk, so that
the rows themselves stay in the task that holds their chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in a chunk: what one task holds of a source at once.
CHUNK = 1 << 16
_MOST_BROADCAST = 200_000


def chunk_of(place: str | Column, chunk: int = CHUNK) -> Column:
    """Number of the chunk in which a place lies."""
    place = F.col(place) if isinstance(place, str) else place
    return F.floor(place / F.lit(chunk)).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has few rows; else joins shuffle it."""
    return F.broadcast(df) if rows <= _MOST_BROADCAST else df


def earlier(order: str = "chunk") -> Window:
    """All chunks of the source before a chunk."""
    return Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def several(summaries: DataFrame) -> DataFrame:
    """The summaries (source, chunk, ...) of sources that have more than one."""
    return summaries.withColumn("_n", F.count("*").over(Window.partitionBy("source"))).filter("_n > 1").drop("_n")


def in_chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rows with the chunk of their ord; rows that have a chunk keep it, and with it the tasks that they are dealt to."""
    return rows if "chunk" in rows.columns else rows.withColumn("chunk", chunk_of("ord", chunk))


def last_before(rows: DataFrame, value: str) -> DataFrame:
    """source, chunk, ``value`` of the last row (source, chunk, ord, value) before the chunk, where there is one."""
    last = rows.groupBy("source", "chunk").agg(F.max_by(value, "ord").alias(value))
    return last.withColumn(value, F.lag(value).over(Window.partitionBy("source").orderBy("chunk"))).filter(F.col(value).isNotNull())


def rows_after(rows: DataFrame, n: int) -> DataFrame:
    """source, chunk, after: the n rows of the source that follow a chunk, in order, where there are any."""
    nth = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("ord"))
    # Nothing precedes the chunk 0, so short sources take no part in this.
    of = F.struct("ord", *[c for c in rows.columns if c not in ("source", "chunk", "ord")])
    heads = rows.filter("chunk > 0").withColumn("_nth", nth).filter(F.col("_nth") <= n).groupBy("source", "chunk").agg(F.sort_array(F.collect_list(of)).alias("head"))
    # Only chunks that have rows of their own receive any.
    own = rows.select("source", "chunk").distinct()
    held = own.join(heads, ["source", "chunk"], "left").withColumn("head", F.coalesce("head", F.array().cast(heads.schema["head"].dataType)))
    later = Window.partitionBy("source").orderBy("chunk").rowsBetween(1, n)
    return held.select("source", "chunk", F.slice(F.flatten(F.collect_list("head").over(later)), 1, n).alias("after")).filter(F.size("after") > 0)
