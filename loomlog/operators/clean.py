"""Noise and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.text import trim_all, utf16_length
from loomlog.operators.chunks import CHUNK, in_chunks, last_before

#: Commands that say nothing (fixed values).
NOISE = ("ls", "cd", "clear", "exit", "pwd", "history")


def is_noise(command: Column) -> Column:
    c = trim_all(command)
    return (utf16_length(c) <= 1) | F.lower(c).isin(*NOISE)


def drop_noise(entries: DataFrame) -> DataFrame:
    return entries.filter(~is_noise(F.col("command")))


def drop_repeats(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Of each run of equal commands in a source the first."""
    rows = in_chunks(entries, chunk)
    first = last_before(rows.select("source", "chunk", "ord", F.col("command").alias("_first")), "_first")
    before = F.coalesce(F.lag("command").over(Window.partitionBy("source", "chunk").orderBy("ord")), "_first")
    kept = rows.join(first, ["source", "chunk"], "left").withColumn("_before", before)
    return kept.filter("_before IS NULL OR _before <> command").select(*entries.columns)


def clean(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return drop_repeats(drop_noise(entries), chunk)
