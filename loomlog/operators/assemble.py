"""Lines to entries: time lines, continued commands, and the extended format.

A source may be too long for one task, so its lines are dealt in chunks.  An entry's lines must
meet, so those that an entry has beyond its chunk move to the chunk where it belongs (its home).  Which
lines move, and which time is pending where a chunk begins, follows from one summary row per chunk:
the summary is the chunk's effect on the state, and a running maximum over the summaries composes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.text import trim_all, trim_end
from loomlog.operators.chunks import CHUNK, chunk_of, earlier, several, small
from loomlog.session import checkpointed
from loomlog.sources.history import DEFAULT_LINES, tail_lines

TIME_LINE = r"^#[0-9]{9,11}\z"
#: The command of an extended line has no line or paragraph break, not even a lone CR (fixed value).
EXTENDED = "^:\\s*([0-9]{9,11}):([0-9]+);([^\\n\\r\\u2028\\u2029]*)\\z"
SNIFFED_LINES = 20


def _epoch(c: Column) -> Column:
    return F.timestamp_seconds(c.cast("long"))


def _continued(body: Column) -> Column:
    return F.endswith(body, F.lit("\\"))


def _joined(place: str, piece: str, where: Column | None = None) -> Column:
    """The pieces of a group in the order of their places, as one command."""
    row = F.struct(place, piece)
    return F.array_join(F.transform(F.sort_array(F.collect_list(row if where is None else F.when(where, row))), lambda x: x[piece]), "\n")


def _plain_rows(lines: DataFrame, chunk: int) -> DataFrame:
    raw, whole = trim_end(F.col("raw")), trim_all(F.col("raw"))
    kind = F.when(F.startswith(whole, F.lit("#")) & whole.rlike(TIME_LINE), "time").when(_continued(raw), "open").otherwise("end")
    rows = lines.select("source", chunk_of("line_idx", chunk).alias("chunk"), F.col("line_idx").cast("long").alias("line_idx"), "line_number", kind.alias("kind"), raw.alias("body"))
    is_open, is_time = F.col("kind") == "open", F.col("kind") == "time"
    return rows.withColumns({"epoch": F.when(is_time, F.substr(trim_all(F.col("body")), F.lit(2)).cast("long")), "body": F.when(is_open, F.substr("body", F.lit(1), F.length("body") - 1)).when(~is_time, F.col("body"))})


def _at_home(rows: DataFrame, ends: DataFrame, n_ends: int) -> DataFrame:
    """Lines after a chunk's last end move to the next chunk that has one; without one they end no entry."""
    if not n_ends:
        return rows.withColumn("home", F.col("chunk"))
    moved = rows.join(small(ends, n_ends), ["source", "chunk"], "left")
    stays = F.col("next_home").isNull() & F.col("last_end").isNull() & F.col("known").isNull() | (F.col("line_idx") <= F.col("last_end"))
    return moved.withColumn("home", F.when(stays, F.col("chunk")).otherwise(F.col("next_home"))).filter("home IS NOT NULL").drop("last_end", "next_home", "known")


def _plain_groups(rows: DataFrame, text: bool) -> DataFrame:
    """Runs of lines that end with a line that is not continued; without ``text`` only what moves the state."""
    before = Window.partitionBy("source", "home").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    is_text, is_end, is_time = F.col("kind") != "time", F.col("kind") == "end", F.col("kind") == "time"
    rows = rows.withColumn("grp", F.coalesce(F.sum(is_end.cast("long")).over(before), F.lit(0)))
    aggs = [
        F.max(is_end).alias("closed"),
        F.max(F.when(is_end, F.col("line_idx"))).alias("ord"),
        F.max(F.when(is_time, F.struct("line_idx", "epoch"))).alias("stamp"),
        F.max((F.col("kind") == "open") | (is_text & (F.col("body") != ""))).alias("ends_stamp"),
    ]
    if text:
        aggs += [F.min(F.when(is_text, F.col("line_number"))).alias("line_number"), trim_all(_joined("line_idx", "body", is_text)).alias("command")]
    return rows.groupBy("source", "home", "grp").agg(*aggs).withColumn("reset", F.when(F.col("closed") & F.col("ends_stamp"), F.col("ord")))


def plain_entries(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Entries of sources in the plain format."""
    rows = _plain_rows(lines, chunk)
    last = several(rows.groupBy("source", "chunk").agg(F.max(F.when(F.col("kind") == "end", F.col("line_idx"))).alias("last_end")))
    after = Window.partitionBy("source").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    ends = checkpointed(last.select("source", "chunk", "last_end", F.first(F.when(F.col("last_end").isNotNull(), F.col("chunk")), ignorenulls=True).over(after).alias("next_home"), F.lit(1).alias("known")))
    n_ends = ends.count()
    groups = _plain_groups(_at_home(rows, ends, n_ends), True)
    in_chunk = Window.partitionBy("source", "home").orderBy("grp")
    groups = groups.withColumns(
        {
            "stamp": F.max("stamp").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)),
            "reset": F.max("reset").over(in_chunk.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    if n_ends:  # the state in which a chunk begins, for sources of several chunks
        own = rows.join(small(ends.select("source").distinct(), n_ends), "source", "left_semi").withColumn("body", F.when(F.col("body") == "", F.lit("")).otherwise(F.lit("x")))
        state = _plain_groups(_at_home(own, ends, n_ends), False).groupBy("source", "home").agg(F.max("stamp").alias("s"), F.max("reset").alias("r"))
        begin = checkpointed(state.select("source", "home", F.max("s").over(earlier("home")).alias("s"), F.max("r").over(earlier("home")).alias("r")))
        groups = groups.join(small(begin, n_ends), ["source", "home"], "left").withColumns({"stamp": F.greatest("stamp", "s"), "reset": F.greatest("reset", "r")})
    # The last time line counts unless an entry has taken it.
    epoch = F.when(F.col("stamp.line_idx") > F.coalesce("reset", F.lit(-1)), F.col("stamp.epoch"))
    return groups.filter(F.col("closed") & (F.col("command") != "")).select("source", "ord", "command", _epoch(epoch).alias("timestamp"), "line_number")


def extended_entries(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Entries of sources in the extended format."""
    raw = F.col("raw")
    is_ext = F.startswith(raw, F.lit(":")) & raw.rlike(EXTENDED)
    rows = lines.select("source", chunk_of("line_idx", chunk).alias("chunk"), F.col("line_idx").cast("long").alias("line_idx"), "line_number", is_ext.alias("ext"), "raw")
    part = lambda n: F.regexp_extract("raw", EXTENDED, n)
    rows = rows.withColumns({"epoch": F.when(F.col("ext"), part(1)), "body": trim_end(F.when(F.col("ext"), part(3)).otherwise(raw))}).drop("raw").withColumn("goes_on", _continued(F.col("body")))
    opens, closes = F.col("ext") & F.col("goes_on"), ~F.col("ext") & ~F.col("goes_on")
    at = lambda f, which: f(F.when(which, F.col("line_idx")))
    sums = several(rows.groupBy("source", "chunk").agg(at(F.max, opens).alias("open"), at(F.max, closes).alias("close"), at(F.min, opens).alias("first_open"), at(F.min, closes).alias("first_close")))
    begin = sums.select("source", "chunk", F.max("open").over(earlier()).alias("open"), F.max("close").over(earlier()).alias("close"), "first_open", "first_close")
    begin = checkpointed(begin.filter("open > coalesce(close, -1)").select("source", "chunk", chunk_of("open", chunk).alias("open_home"), F.least("first_open", F.col("first_close") + 1).alias("until")))
    if n := begin.count():  # a command is open where these chunks begin: its lines move to where it began
        moves = ~F.col("ext") & F.col("open_home").isNotNull() & (F.col("until").isNull() | (F.col("line_idx") < F.col("until")))
        rows = rows.join(small(begin, n), ["source", "chunk"], "left").withColumn("home", F.when(moves, F.col("open_home")).otherwise(F.col("chunk"))).drop("open_home", "until")
    else:
        rows = rows.withColumn("home", F.col("chunk"))
    own = Window.partitionBy("source", "home").orderBy("line_idx")
    opened = at(F.max, opens).over(own.rowsBetween(Window.unboundedPreceding, 0))
    closed = at(F.max, closes).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"opened": opened, "closed": closed})
    inside = opens | (~F.col("ext") & (F.col("opened") > F.coalesce("closed", F.lit(-1))))
    # Lines of one command share the line that opened it; any other line is a command of its own.
    rows = rows.withColumn("opened", F.when(F.coalesce(inside, F.lit(False)), F.col("opened")))
    piece = F.when(F.col("goes_on") & F.col("opened").isNotNull(), F.substr("body", F.lit(1), F.length("body") - 1)).otherwise(F.col("body"))
    entries = rows.withColumn("piece", piece).groupBy("source", "home", F.coalesce("opened", "line_idx").alias("begin"), F.col("opened").isNull().alias("alone")).agg(
        F.max(F.when(closes | F.col("opened").isNull(), F.col("line_idx"))).alias("ord"),
        F.min("line_number").alias("line_number"),
        F.max("epoch").alias("epoch"),
        trim_all(_joined("line_idx", "piece")).alias("command"),
    )
    return entries.filter("ord IS NOT NULL AND command <> ''").select("source", "ord", "command", _epoch(F.col("epoch")).alias("timestamp"), "line_number")


def is_extended(lines: DataFrame) -> DataFrame:
    """Sources one of whose first non-blank lines has the extended format."""
    order = Window.partitionBy("source").orderBy("line_idx")
    shown = lines.filter(trim_all(F.col("raw")) != "").select("source", "line_idx", (F.startswith("raw", F.lit(":")) & F.col("raw").rlike(EXTENDED)).alias("ext"))
    # Spark keeps that many rows of a source in each task before it shuffles them.
    return shown.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SNIFFED_LINES).filter("ext").select("source").distinct()


def assemble(lines: DataFrame, shell: str | None = None, max_lines: int | None = DEFAULT_LINES, chunk: int = CHUNK) -> DataFrame:
    """Entries of the tail of each source, before any cleaning."""
    kept = tail_lines(lines, max_lines)
    if shell == "zsh":
        return extended_entries(kept, chunk)
    found = checkpointed(is_extended(kept))
    n = found.count()
    if not n:
        return plain_entries(kept, chunk)
    found = small(found, n)
    return plain_entries(kept.join(found, "source", "left_anti"), chunk).unionByName(extended_entries(kept.join(found, "source", "left_semi"), chunk))
