"""A bitmap of keys as a small table, to keep most rows out of a shuffle.

The bitmap says of a key "surely not in the set" or "maybe".  It has 16 bits for each key, at least
2**16 and at most ``MOST_BITS``, so the broadcast table of its words is bounded whatever the set.
Beyond that bound more rows are called maybe; an exact join decides those, so no result depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.cluster import checkpointed
from loomlog.session import tasks_for

MOST_BITS = 1 << 25


class BitSet:
    def __init__(self, keys: DataFrame, column: str, most_bits: int = MOST_BITS):
        size = keys.count()
        self.bits = 1 << 16
        while self.bits < min(16 * size, most_bits):
            self.bits *= 2
        place = F.pmod(F.col(column), F.lit(self.bits))
        words = keys.groupBy(F.shiftright(place, 6).cast("int").alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("_set"))
        self.words = checkpointed(words, tasks_for(self.bits // 64))  # at most bits / 64 rows

    def part(self, rows: DataFrame, key: Column, maybe: bool) -> DataFrame:
        """The rows whose key may be in the set, or those whose key surely is not."""
        names = rows.columns
        place = F.pmod(key, F.lit(self.bits))
        joined = rows.withColumn("_place", place).join(F.broadcast(self.words), F.shiftright(F.col("_place"), 6).cast("int") == F.col("_word"), "left")
        bit = F.expr("shiftright(_set, CAST(pmod(_place, 64) AS INT)) & 1")
        return joined.filter(F.coalesce(bit, F.lit(0).cast("long")) == (1 if maybe else 0)).select(*[F.col(f"`{c}`") for c in names])
