"""Search by a stored index: the same rows as ``search`` without scoring every command.

Three tables lie in the folder of an index:

- ``postings``: token, id, frequency, frequency_score, recency_score; in buckets by the hash of the token, ordered by
  token and id, so that a search reads the buckets and row groups of its tokens.
- ``tokens``: the distinct tokens with their bucket.
- ``commands``: id, command, frequency, last_used, line_number and both scores; ordered by what a command scores without
  any match (``prior``), so that the few best of them are read alone.

Ids follow the order of first use, so they decide ties.  An index is of the entries it was built from; build
it anew, in another folder, when there are more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import text as T
from loomlog.operators.chunks import small
from loomlog.operators.search import MAX_RESULTS, MIN_SCORE, command_stats
from loomlog.session import checkpointed

BUCKETS = 64
#: What a command scores at most without any match.
_MOST_PRIOR = T.WEIGHTS["frequency"] + T.WEIGHTS["recency"]
#: Query tokens whose marks one long holds.
_MARKS = 62


def build_index(entries: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of entries into a new folder.

    The commands of a token are split over tasks by id, however many they are.
    """
    spark = entries.sparkSession
    # Sorted over all tasks and stored, so that ids stay the same whoever computes them again.
    stats = checkpointed(command_stats(entries).orderBy("first").withColumn("id", F.monotonically_increasing_id()).drop("first"))
    totals = stats.agg(F.greatest(F.max("frequency"), F.lit(1)).alias("most"), F.max("last_used").alias("newest"))
    scored = (
        stats.crossJoin(F.broadcast(totals))  # one row
        .withColumn("frequency_score", T.frequency_score(F.col("frequency"), F.col("most")).cast("double"))
        .withColumn("recency_score", T.recency_score(F.col("last_used"), F.col("newest")).cast("double"))
        .drop("most", "newest")
    )
    commands = scored.withColumn("prior", _total(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    commands.repartitionByRange(F.desc("prior"), "id").sortWithinPartitions(F.desc("prior"), "id").write.parquet(f"{path}/commands")
    each = scored.select("id", "frequency", "frequency_score", "recency_score", F.explode(F.array_distinct(T.tokenize(F.col("command")))).alias("token"))
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    dealt = each.withColumn("bucket", bucket).repartitionByRange("bucket", "token", "id").sortWithinPartitions("bucket", "token", "id")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    _postings(spark, path).select("bucket", "token").distinct().write.parquet(f"{path}/tokens")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    # An index without any token has no file that would tell the columns.
    return spark.read.schema("id long, frequency long, frequency_score double, recency_score double, token string, bucket int").parquet(f"{path}/postings")


def _total(exact: Column, fuzzy: Column, substring: Column) -> Column:
    """The score, in the order of evaluation that ``search`` has."""
    parts = {"exact": exact, "fuzzy": fuzzy, "substring": substring, "frequency": F.col("frequency_score"), "recency": F.col("recency_score")}
    total = None
    for name, weight in T.WEIGHTS.items():
        term = F.lit(weight) * parts[name]
        total = term if total is None else total + term
    return total


def _marks(query: list[str], holds) -> list[Column]:
    """Longs with a bit for each query token of which ``holds`` is true."""
    return [
        sum((F.when(holds(q), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, q in enumerate(query[at : at + _MARKS])), F.lit(0).cast("long"))
        for at in range(0, len(query), _MARKS)
    ]


def matched_tokens(tokens: DataFrame, query: str) -> DataFrame:
    """The tokens that may count for a query, with marks of the query tokens they equal (e), nearly equal (f) or share a
    prefix with (p), and whether they hold its first token (held)."""
    asked = T.tokenize_text(query)
    token, units = F.col("token"), T.utf16(F.col("token"))
    close = lambda q: (F.abs(F.length(units) - len(T.utf16_text(q))) <= T.MAX_TYPO) & (F.levenshtein(units, F.lit(T.utf16_text(q)), T.MAX_TYPO) >= 0)
    kinds = {
        "e": _marks(asked, lambda q: token == q),
        "f": _marks(asked, close),
        "p": _marks(asked, lambda q: F.startswith(token, F.lit(q)) | F.startswith(F.lit(q), token)),
    }
    marked = tokens.select("bucket", "token", *[m.alias(f"{k}{i}") for k, ms in kinds.items() for i, m in enumerate(ms)], F.contains(token, F.lit(asked[0])).alias("held"))
    names = [f"{k}{i}" for k, ms in kinds.items() for i in range(len(ms))]
    return marked.filter(" OR ".join([*[f"{n} <> 0" for n in names], "held"]))


def _bits(kind: str, n: int, but: str | None = None) -> Column:
    """How many query tokens have a mark of a kind, and none of another."""
    marks = [F.col(f"{kind}{i}").bitwiseAND(F.bitwise_not(F.col(f"{but}{i}"))) if but else F.col(f"{kind}{i}") for i in range(n)]
    return sum((F.bit_count(m) for m in marks), F.lit(0))


def search_index(spark: SparkSession, path: str, query: str, max_results: int | None = MAX_RESULTS) -> DataFrame:
    """command, score, last_used, frequency, line_number: best first, as ``search`` finds them.

    The distinct tokens are compared with the query's.  The postings of those that match give each of their commands a
    score that is exact but for one thing: whether the command holds the query as typed.  That can only be if a token of
    it holds the query's first token, and gives a bound above; only commands whose bound reaches the last of the best are
    read.  Commands without a match score by frequency and recency alone; the best of them are read when no more
    than max_results others are above all of theirs.
    """
    commands = spark.read.parquet(f"{path}/commands")
    k = MAX_RESULTS if max_results is None else max_results
    asked = T.tokenize_text(query)
    out = ["command", "score", "last_used", "frequency", "line_number"]
    if not query.strip() or not asked or k < 1:
        return commands.withColumn("score", F.col("prior")).limit(0).select(*out)
    found = matched_tokens(spark.read.parquet(f"{path}/tokens"), query).persist()
    try:
        n_found = found.count()
        n = -(-len(asked) // _MARKS)
        names = [f"{kind}{i}" for kind in "efp" for i in range(n)]
        hits = _postings(spark, path).join(small(found, n_found), ["bucket", "token"])
        per = hits.groupBy("id").agg(*[F.bit_or(c).alias(c) for c in names], F.max("held").alias("held"), *[F.first(c).alias(c) for c in ("frequency", "frequency_score", "recency_score")])
        size = F.lit(float(len(asked)))
        exact = _bits("e", n) / size
        fuzzy = F.when(_bits("e", n) == len(asked), F.lit(1.0)).otherwise(_bits("f", n, "e") / size)
        shared = _bits("p", n) / size
        typed = query.lower() == asked[0]  # then a token that holds it is all that is asked
        low = _total(exact, fuzzy, F.when(F.col("held"), F.lit(1.0)).otherwise(shared) if typed else shared)
        high = _total(exact, fuzzy, F.when(F.col("held"), F.lit(1.0)).otherwise(shared))
        scored = checkpointed(per.select("id", "frequency", low.alias("low"), high.alias("high")))
    finally:
        found.unpersist()
    # The last of the k best by the lower bounds: whatever is not above it by the upper bound is not among the best.
    best = scored.filter(F.col("low") >= MIN_SCORE).select(T.round3(F.col("low")).alias("s"), "frequency", "id").orderBy(F.desc("s"), F.desc("frequency"), "id").limit(k).collect()
    may = scored.filter(F.col("high") >= MIN_SCORE)
    full = len(best) == k
    if full:
        s, f, i = best[-1]
        r = T.round3(F.col("high"))
        may = may.filter((r > s) | (r == s) & ((F.col("frequency") > f) | (F.col("frequency") == f) & (F.col("id") <= i)))
    held = F.contains(F.lower(F.col("command")), F.lit(query.lower()))
    exact_score = F.when(held, F.col("high")).otherwise(F.col("low"))
    rows = commands.join(may.select("id", "low", "high"), "id").withColumn("score", exact_score)
    if not full or best[-1]["s"] <= _MOST_PRIOR + 0.001:
        rest = commands.filter(F.col("prior") >= MIN_SCORE).join(scored.select("id"), "id", "left_anti")
        rest = rest.withColumn("score", F.col("prior")).withColumn("score_", T.round3(F.col("prior"))).orderBy(F.desc("score_"), F.desc("frequency"), "id").limit(k).drop("score_")
        rows = rows.drop("low", "high").unionByName(rest)
    return rows.filter(F.col("score") >= MIN_SCORE).withColumn("score", T.round3(F.col("score"))).orderBy(F.desc("score"), F.desc("frequency"), "id").limit(k).select(*out)
