"""Frequent commands and sequences, grouped with their near copies."""

# Lengths and distances are counted in UTF-16 units, as the ranks and reports of the commands expect.

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.text import utf16
from loomlog.operators.chunks import CHUNK, in_chunks, rows_after, small
from loomlog.operators.components import components
from loomlog.session import checkpointed

MIN_FREQUENCY, TOP, THRESHOLD, SHORTEST, LONGEST = 5, 20, 3, 2, 5
JOINER = " && "
#: Near pairs that one task decides at once.
MOST_PAIRS = 1 << 18
#: Keys that share a segment above which they must share one more to meet.
MOST_SHARING = 32


def count_commands(entries: DataFrame) -> DataFrame:
    """key, count, last_used, kind 0, window 1, first (place of the first use)."""
    return entries.groupBy(F.col("command").alias("key")).agg(F.count("*").alias("count"), F.max("timestamp").alias("last_used"), F.lit(0).alias("kind"), F.lit(1).alias("window"), F.min(F.struct("source", "ord")).alias("first"))


def digest(key: Column) -> Column:
    """The MD5 of a string and 64 bits more: what tells strings apart where they are too long to be moved."""
    return F.concat(F.unhex(F.md5(key)), F.unhex(F.lpad(F.hex(F.xxhash64(key)), 16, "0")))


def count_sequences(entries: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, chunk: int = CHUNK, known_by: Callable[[Column], Column] | None = None) -> DataFrame:
    """The same for runs of neighbouring commands of a source, joined; equal strings count together.

    A command is part of up to longest * (longest + 1) / 2 strings, which are all moved to be counted; with
    ``known_by`` (as ``digest``) only what it makes of them is, and is the key.
    """
    if longest < shortest:
        return count_commands(entries.limit(0))
    columns = ["source", "ord", "command", "timestamp"]
    rows = in_chunks(entries.select(*columns, *(["chunk"] if "chunk" in entries.columns else [])), chunk)
    order = Window.partitionBy("source", "chunk").orderBy("ord")
    steps = range(1, longest)
    lead = {(c, k): F.lead(c, k).over(order).alias(f"{c}_{k}") for c in columns[1:] for k in steps}
    held = rows.join(rows_after(rows, longest - 1), ["source", "chunk"], "left").select(*columns, "after", *lead.values())
    here = sum((F.col(f"ord_{k}").isNotNull().cast("int") for k in steps), F.lit(0))  # rows that follow in the chunk
    next_ = lambda c, k: F.when(F.col(f"ord_{k}").isNotNull(), F.col(f"{c}_{k}")).otherwise(F.get("after", F.greatest(F.lit(k - 1) - here, F.lit(0)))[c])
    rows = held.select("source", "ord", "command", "timestamp", *[next_("command", k).alias(f"c{k}") for k in steps], *[next_("timestamp", k).alias(f"t{k}") for k in steps])
    name = known_by or (lambda key: key)
    runs = [
        F.when(F.col(f"c{w - 1}").isNotNull() if w > 1 else F.lit(True), F.struct(name(F.concat_ws(JOINER, "command", *[f"c{k}" for k in range(1, w)])).alias("key"), F.col(f"t{w - 1}" if w > 1 else "timestamp").alias("used"), F.lit(w).alias("window")))
        for w in range(shortest, longest + 1)
    ]
    each = rows.select("source", "ord", F.explode(F.array_compact(F.array(*runs))).alias("run"))
    return each.groupBy(F.col("run.key").alias("key")).agg(F.count("*").alias("count"), F.max("run.used").alias("last_used"), F.lit(1).alias("kind"), F.min("run.window").alias("window"), F.min(F.struct("source", "ord")).alias("first"))


def merged_counts(entries: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """Commands, and the sequences whose string is not a command."""
    single = count_commands(entries)
    return single.unionByName(count_sequences(entries, shortest, longest).join(single.select("key"), "key", "left_anti"))


def rank() -> Column:
    """What decides which of two keys leads: the lesser struct."""
    return F.struct((-F.col("count")).alias("c"), "kind", "window", F.col("first").alias("f"), F.col("key").alias("k"))


def _segment(n: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of the parts into which a string of length n is cut."""
    base, longer = F.floor(n / parts), n % parts
    extra = F.greatest(F.lit(0), i - (parts - longer))  # the last parts are longer by one
    return (i * base + extra).cast("int"), (base + (i >= parts - longer).cast("int")).cast("int")


def _places(threshold: int) -> list[tuple[int, int, int]]:
    """What a key looks for in keys that are not longer: their length less its own, segment number, shift of the segment.

    The number of edits left and right of an unchanged segment bounds its shift.
    """
    return [
        (diff, i, shift)
        for diff in range(-threshold, 1)
        for i in range(threshold + 1)
        for shift in range(max(-i, -diff - (threshold - i)), min(i, -diff + threshold - i) + 1)
    ]


def _met(token: Column, n: Column, i: Column, at: Column, size: Column) -> list[Column]:
    """The token of a segment of ``rest``, which extends the token so far, and what is left of rest without it."""
    rest = F.col("rest")
    met = F.xxhash64(token, n, i, F.substr(rest, at + 1, size)).alias("token")
    return [met, F.concat(F.left(rest, at), F.substr(rest, at + size + 1)).alias("rest")]


def _index(rows: DataFrame, threshold: int) -> DataFrame:
    """token, id, rest of each segment of the rests (token, id, rest)."""
    cut = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(threshold))))
    n = F.length("rest")
    return cut.select("id", *_met(F.col("token"), n, F.col("i"), *_segment(n, F.col("i"), threshold + 1)))


def _probes(rows: DataFrame, threshold: int) -> DataFrame:
    """token, id, d, rest of each place where a segment of a rest shorter by -d may lie in the rests (token, id, d, rest)."""
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("dis", place)]) for place in _places(threshold)])
    seen = rows.withColumn("p", F.explode(F.filter(table, lambda p: F.col("d").isNull() | (p["d"] == F.col("d")))))
    n = F.length("rest") + F.col("p.d")
    start, size = _segment(n, F.col("p.i"), threshold + 1)
    at = start + F.col("p.s")
    fits = seen.filter((n >= 0) & (at >= 0) & (at + size <= F.length("rest")))
    return fits.select("id", F.col("p.d").alias("d"), *_met(F.col("token"), n, F.col("p.i"), at, size))


def _candidates(keys: DataFrame, threshold: int, most: int, depth: int) -> DataFrame:
    """Pairs of ids (a, b; a is not longer) among which all near ones are; keys: id, rest."""
    index = _index(keys.withColumn("token", F.lit(0).cast("long")), threshold)
    probes = _probes(keys.select("id", "rest", F.lit(0).cast("long").alias("token"), F.lit(None).cast("int").alias("d")), threshold)
    out = None
    for level in range(depth):
        last = level == depth - 1
        hot = None if last else checkpointed(index.groupBy("token").count().filter(F.col("count") > most).select("token"))
        n_hot = 0 if last else hot.count()
        rare, asked = index, probes
        if n_hot:
            hot = small(hot, n_hot)
            rare, asked = index.join(hot, "token", "left_anti"), probes.join(hot, "token", "left_anti")
        met = rare.select("token", F.col("id").alias("a")).join(asked.select("token", "d", F.col("id").alias("b")), "token").filter((F.col("d") < 0) | (F.col("a") <= F.col("b"))).select("a", "b")
        out = met if out is None else out.unionByName(met)
        if not n_hot:
            return out.distinct()
        index = checkpointed(_index(index.join(hot, "token", "left_semi"), threshold))
        probes = checkpointed(_probes(probes.join(hot, "token", "left_semi"), threshold))
    return out.distinct()


def near_pairs(keys: DataFrame, threshold: int = THRESHOLD, most: int = MOST_SHARING, depth: int = 4) -> DataFrame:
    """low, low_rank, high, high_rank: keys within the edit distance, the leading one first.

    Each key is cut into threshold + 1 segments.  Of two keys within the distance, the longer has a segment
    of the other unchanged, near its old place, so keys meet on length, segment number and segment.  What is left
    of both without that segment is within the distance as well: where more than ``most`` keys share a segment they
    meet on a segment of what is left too, and so on, ``depth`` times at most.  So a key meets a bounded number of
    others at each place, unless more than that agree in two thirds of their text; of those most are near indeed.
    """
    keys = keys.select("key", "rank", utf16(F.col("key")).alias("u")).withColumn("id", F.xxhash64("u"))
    met = _candidates(keys.select("id", F.col("u").alias("rest")), threshold, most, depth)
    a, b = (keys.select(F.col("id").alias(x), F.col("key").alias(f"key_{x}"), F.col("u").alias(f"u_{x}"), F.col("rank").alias(f"rank_{x}")) for x in "ab")
    # Ids are hashes: keys whose hashes collide all take part, and what each pair is worth the distance says.
    near = met.join(a, "a").join(b, "b").filter((F.col("key_a") != F.col("key_b")) & (F.levenshtein("u_a", "u_b", threshold) >= 0))
    first = F.col("rank_a") < F.col("rank_b")
    pick = lambda c, x, y: F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    out = near.select(pick("key", "a", "b").alias("low"), pick("rank", "a", "b").alias("low_rank"), pick("key", "b", "a").alias("high"), pick("rank", "b", "a").alias("high_rank"))
    return out.distinct()


def _led(batch: pa.Table) -> pa.Table:
    """high and its leader, for the pairs of whole components (low, high and their orders): one greedy pass by order."""
    lower: dict[int, list[int]] = {}
    names: dict[int, str] = {}
    columns = (batch[c].to_pylist() for c in ("low_order", "high_order", "low", "high"))
    for low, high, low_key, high_key in zip(*columns):
        lower.setdefault(high, []).append(low)
        names[low], names[high] = low_key, high_key
    led: dict[int, int] = {}
    for k in sorted(lower):
        leaders = [x for x in lower[k] if x not in led]
        if leaders:
            led[k] = min(leaders)
    return pa.table({"high": pa.array([names[k] for k in led], pa.string()), "leader": pa.array([names[k] for k in led.values()], pa.string())})


def _led_in_rounds(pairs: DataFrame) -> DataFrame:
    """The same over tables, for components too large for a task: each round decides the keys whose lower ones are decided."""
    nodes = pairs.select(F.col("low").alias("key")).union(pairs.select("high")).distinct()
    tops = pairs.select(F.col("high").alias("top")).distinct()
    state = checkpointed(nodes.join(tops, F.col("key") == F.col("top"), "left").select("key", F.when(F.col("top").isNull(), "leads").alias("state")))
    while not state.filter("state IS NULL").isEmpty():
        seen = pairs.join(state.select(F.col("key").alias("low"), F.col("state").alias("s")), "low").groupBy("high").agg(F.max(F.coalesce(F.col("s") == "leads", F.lit(False))).alias("led"), F.max(F.col("s").isNull()).alias("open"))
        new = F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("led"), "follows").when(~F.col("open"), "leads")
        state = checkpointed(state.join(seen, F.col("key") == F.col("high"), "left").select("key", new.alias("state")))
    leaders = state.filter("state = 'leads'").select(F.col("key").alias("leader"))
    return pairs.join(leaders, F.col("low") == F.col("leader")).groupBy("high").agg(F.min_by("leader", "low_order").alias("leader"))


def followers(pairs: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """high, leader: the keys that a key of lesser order absorbs.

    pairs: low, high, low_order, high_order (long).  Whole components of pairs are decided by one pass
    in a task each; only components of more than ``most_pairs`` pairs take rounds over tables.
    """
    n = pairs.count()
    schema = "high string, leader string"
    if n <= most_pairs:  # all components fit one task
        return pairs.coalesce(1).groupBy(F.lit(0).alias("group")).applyInArrow(_led, schema)
    found = components(pairs.select(F.col("low_order").alias("u"), F.col("high_order").alias("v"))).withColumnRenamed("node", "of")
    of_pair = pairs.join(found, F.col("high_order") == F.col("of")).drop("of")  # the higher key is never the least of its component
    sizes = of_pair.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("pairs"))
    sized = checkpointed(of_pair.join(sizes, F.col("component") == F.col("c")))
    groups = -(-n // most_pairs)  # components are dealt so that a task has about as many pairs as it may
    out = sized.filter(F.col("pairs") <= most_pairs).groupBy(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("group")).applyInArrow(_led, schema)
    large = sized.filter(F.col("pairs") > most_pairs).select(pairs.columns)
    return out if large.isEmpty() else out.unionByName(_led_in_rounds(large))


def group_similar(counts: DataFrame, threshold: int = THRESHOLD, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """pattern, frequency, last_used, variations, rank.

    A key leads unless it is near a leader of lesser rank, which then absorbs it; of several the one of least rank.
    """
    keys = checkpointed(counts.withColumn("rank", rank()))
    pairs = checkpointed(near_pairs(keys, threshold))
    ends = pairs.select(F.explode(F.array(F.col("low_rank"), F.col("high_rank"))).alias("r")).distinct()
    # The orders of keys that are near some key; sorted over all tasks, numbered within and across them.
    sorted_ = checkpointed(ends.orderBy("r").select("r", F.monotonically_increasing_id().alias("order")))
    low, high = (sorted_.select(F.col("r.k").alias(f"{x}_k"), F.col("order").alias(f"{x}_order")) for x in ("low", "high"))
    ordered = checkpointed(pairs.select("low", "high").join(low, F.col("low") == F.col("low_k")).join(high, F.col("high") == F.col("high_k")).select("low", "high", "low_order", "high_order"))
    member = keys.join(followers(ordered, most_pairs), F.col("key") == F.col("high"), "left").withColumn("pattern", F.coalesce("leader", "key"))
    follower = F.when(F.col("leader").isNotNull(), F.struct("rank", "key"))
    return member.groupBy("pattern").agg(
        F.sum("count").alias("frequency"),
        F.max("last_used").alias("last_used"),
        F.transform(F.sort_array(F.collect_list(follower)), lambda x: x["key"]).alias("variations"),
        F.min("rank").alias("rank"),
    )


def analyze_frequency(entries: DataFrame, min_frequency: int | None = MIN_FREQUENCY, top: int | None = TOP, threshold: int = THRESHOLD, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """pattern, frequency, last_used, variations: the most frequent groups, in order."""
    counts = merged_counts(entries, shortest, longest)
    least = MIN_FREQUENCY if min_frequency is None else min_frequency
    found = group_similar(counts, threshold).filter(F.col("frequency") >= least)
    return found.orderBy(F.desc("frequency"), F.desc_nulls_last("last_used"), "rank").limit(TOP if top is None else top).select("pattern", "frequency", "last_used", "variations")
