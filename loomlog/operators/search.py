"""Ranked search that tolerates typos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions import text as T

MIN_SCORE, MAX_RESULTS = 0.05, 10


def command_stats(entries: DataFrame) -> DataFrame:
    """command, frequency, last_used, line_number (the last), first."""
    return entries.groupBy("command").agg(F.count("*").alias("frequency"), F.max("timestamp").alias("last_used"), F.max("line_number").alias("line_number"), F.min(F.struct("source", "ord")).alias("first"))


def score(stats: DataFrame, query: str) -> DataFrame:
    """stats with the unrounded score of each command."""
    tokens = T.tokenize_text(query)
    totals = stats.agg(F.greatest(F.max("frequency"), F.lit(1)).alias("most"), F.max("last_used").alias("newest"))
    c = F.col("tokens")
    parts = {
        "exact": T.exact_overlap(tokens, c),
        "fuzzy": T.fuzzy_overlap(tokens, c),
        "substring": T.substring_score(query, F.col("command"), tokens, c),
        "frequency": T.frequency_score(F.col("frequency"), F.col("most")),
        "recency": T.recency_score(F.col("last_used"), F.col("newest")),
    }
    total = None
    for name, weight in T.WEIGHTS.items():
        term = F.lit(weight) * parts[name]
        total = term if total is None else total + term
    # One row of totals: a cross join with it is a broadcast of that row.
    return stats.withColumn("tokens", T.tokenize(F.col("command"))).crossJoin(F.broadcast(totals)).withColumn("score", total)


def search(entries: DataFrame, query: str, max_results: int | None = MAX_RESULTS) -> DataFrame:
    """command, score, last_used, frequency, line_number: best first."""
    stats = command_stats(entries)
    if not query.strip() or not T.tokenize_text(query):
        stats = stats.limit(0)
    found = score(stats, query).filter(F.col("score") >= MIN_SCORE).withColumn("score", T.round3(F.col("score")))
    return found.orderBy(F.desc("score"), F.desc("frequency"), "first").limit(MAX_RESULTS if max_results is None else max_results).select("command", "score", "last_used", "frequency", "line_number")
