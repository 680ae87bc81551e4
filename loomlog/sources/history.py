"""History files and other tables as lines and entries.

``read_lines`` takes each file as one value; ``scan_lines`` reads files of any size in many tasks;
``read_tail`` (in ``tail.py``) reads the ends of files alone.

Lines: source, line_idx (from 0), n_lines, raw.  Entries: source, ord, command, timestamp,
line_number (from 1, inside the kept tail).
"""

from __future__ import annotations

import os
import sys
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.session import checkpointed

DEFAULT_LINES, LEAST_LINES = 5000, 100
ALL_LINES = (1 << 31) - 1  # as many as an array of lines can hold
SHELLS = ("bash", "zsh", "powershell")
_MOST_OFFSETS = 1 << 23  # places of four bytes


def lines_of(texts: DataFrame, source: str, text: str) -> DataFrame:
    """Split a text column at LF or CR LF; a lone CR is no break, a final break gives an empty line."""
    parts = texts.select(F.col(source).cast("string").alias("source"), F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n", -1).alias("parts"))
    return parts.select("source", F.size("parts").alias("n_lines"), F.posexplode("parts").alias("line_idx", "raw"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole text files; the source is the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    return lines_of(files, "source", "text")


def _file_blocks(raw: DataFrame) -> DataFrame:
    """Per block of a file: number of its first line, lines of the file, whether a break ends it, and a byte order mark."""
    blocks = raw.groupBy("source", "block").agg(F.min("row").alias("row0"), F.count("*").alias("n"), F.sum(F.octet_length("raw") + 1).alias("bytes"), F.first("size").alias("size"))
    file, upto = Window.partitionBy("source"), Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Without a break at the end the lines come to one byte more than the file; the reader skips a mark of three bytes.
    over = F.sum("bytes").over(file) - F.col("size")
    return blocks.select(
        F.col("source").alias("of"),
        F.col("block").alias("of_block"),
        "row0",
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"),
        F.sum("n").over(file).alias("found"),
        over.isin(0, -3).alias("ended"),
        over.isin(-3, -2).alias("marked"),
        (~over.isin(1, 0, -2, -3)).alias("odd"),
    )


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain text files as ``read_lines`` gives them, but read block by block, in as many tasks.

    A first pass counts the lines of each block of a file; sums over the blocks (not the lines) give
    every line its number.  line_idx and n_lines are long.  Spark's readers skip empty files.  Packed files (.gz and the like) are refused: their
    sizes do not tell whether the last line has ended.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    raw = read.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("raw"))
    blocks = checkpointed(_file_blocks(raw))
    if odd := blocks.filter("odd").select("of").first():
        raise ValueError(f"not a plain text file: {odd[0]}")
    n = blocks.count()
    placed = raw.join(F.broadcast(blocks) if n <= 200_000 else blocks, (F.col("source") == F.col("of")) & (F.col("block") == F.col("of_block")))
    idx = F.col("base") + F.col("row") - F.col("row0")
    n_lines = F.col("found") + F.col("ended").cast("long")
    cut = F.when(F.endswith("raw", F.lit("\r")) & (F.col("ended") | (F.col("line_idx") < F.col("found") - 1)), F.substr("raw", F.lit(1), F.length("raw") - 1)).otherwise(F.col("raw"))
    text = F.when(F.col("marked") & (F.col("line_idx") == 0), F.concat(F.lit("\ufeff"), cut)).otherwise(cut)
    lines = placed.withColumn("line_idx", idx).select("source", n_lines.alias("n_lines"), "line_idx", text.alias("raw"))
    # A break at the end is followed by one empty line.
    last = blocks.filter("ended AND base = 0").select(F.col("of").alias("source"), (F.col("found") + 1).alias("n_lines"), F.col("found").alias("line_idx"), F.lit("").alias("raw"))
    return lines.unionByName(last)


def _offsets(lengths: DataFrame, ranges: DataFrame, chunk: int) -> DataFrame:
    """Per range of keys: the number of lines before it, and before each place in it, as an array."""
    free = ranges.select("range", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunk - 1).cast("long"))).alias("place"), F.lit(0).alias("n"))
    each = lengths.select("range", "place", "n").unionByName(free).groupBy("range", "place").agg(F.sum("n").alias("n"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = each.withColumn("own", own.cast("int")).groupBy("range").agg(F.sort_array(F.collect_list(F.struct("place", "own"))).alias("rows"))
    return rows.join(ranges, "range").select(F.col("range").alias("of"), "base", F.transform("rows", lambda x: x["own"]).alias("owns"))


def texts_as_one(texts: DataFrame, key: str, text: str, source: str, chunk: int = 1 << 12, most: int = _MOST_OFFSETS) -> DataFrame:
    """All texts of a table one after another, in the order of a long key (null last), as the lines of one source.

    Line numbers are sums over the texts before; they are taken within ranges of keys and over the ranges, so no
    task sees all texts.  Where no key repeats and the ranges have at most ``most`` places, each text gets its
    number from a broadcast table of them; else the texts of a range are moved to one task.
    """
    keyed = texts.select(F.col(key).cast("long").alias("key"), F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n", -1).alias("parts"))
    place = F.pmod("key", F.lit(chunk).cast("long"))
    # Numbers below 0 are divided towards 0.  Null keys are the last range.
    of = F.expr(f"key div {chunk}") - ((F.col("key") < 0) & (place != 0)).cast("long")
    parts = keyed.select(F.coalesce(of, F.lit((1 << 63) - 1)).alias("range"), F.coalesce(place, F.lit(0)).alias("place"), "parts")
    lengths = parts.select("range", "place", F.size("parts").alias("n")).groupBy("range", "place").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    lengths = checkpointed(lengths)  # one short row per key
    sums = lengths.groupBy("range").agg(F.sum("n").alias("n"), F.max("c").alias("c"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = checkpointed(sums.select("range", "n", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    n_ranges, n_lines, longest, copies = ranges.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.max("n"), F.max("c")).first()
    if n_ranges and n_ranges * chunk <= most and copies == 1 and longest < 1 << 31:
        offsets = checkpointed(_offsets(lengths, ranges, chunk))
        placed = parts.join(F.broadcast(offsets), F.col("range") == F.col("of")).withColumn("own", F.get("owns", F.col("place").cast("int")).cast("long"))
    else:
        own = F.coalesce(F.sum(F.size("parts")).over(Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bases = ranges.select(F.col("range").alias("of"), "base")
        placed = parts.withColumn("own", own).join(bases, F.col("range") == F.col("of"))
    lines = placed.select(F.lit(source).alias("source"), F.lit(n_lines).cast("long").alias("n_lines"), (F.col("base") + F.col("own")).alias("first"), F.posexplode("parts").alias("pos", "raw"))
    return lines.select("source", "n_lines", (F.col("first") + F.col("pos")).alias("line_idx"), "raw")


def tail_lines(lines: DataFrame, max_lines: int | None = DEFAULT_LINES) -> DataFrame:
    """The last lines of each source (at least 100 of them), numbered from 1 as line_number."""
    keep = max(max_lines if max_lines is not None else DEFAULT_LINES, LEAST_LINES)
    first = F.greatest(F.col("n_lines") - F.lit(keep), F.lit(0))
    return lines.filter(F.col("line_idx") >= first).withColumn("line_number", (F.col("line_idx") - first + 1).cast(lines.schema["line_idx"].dataType))


def events_as_entries(events: DataFrame) -> DataFrame:
    """Each user's events in order, as a log of commands."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return events.select(
        F.col("user_id").cast("string").alias("source"),
        F.row_number().over(w).cast("long").alias("ord"),
        F.col("event_type").alias("command"),
        F.col("ts").alias("timestamp"),
        F.row_number().over(w).cast("int").alias("line_number"),
    )


def parts_as_entries(part: DataFrame) -> DataFrame:
    """Part names with their types as one log."""
    return part.select(
        F.lit("part").alias("source"),
        F.col("p_partkey").cast("long").alias("ord"),
        F.concat_ws(" ", "p_name", "p_type").alias("command"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.col("p_partkey").cast("int").alias("line_number"),
    )


def detect_shell(override: str | None = None, env: Mapping[str, str] | None = None, platform: str = sys.platform) -> str:
    """Shell named by the caller, else by SHELL, else by the platform."""
    if override and override != "auto":
        return override
    env = os.environ if env is None else env
    named = env.get("SHELL", "").lower()
    for word, shell in (("zsh", "zsh"), ("bash", "bash"), ("pwsh", "powershell"), ("powershell", "powershell")):
        if word in named:
            return shell
    return "powershell" if platform == "win32" else "powershell" if env.get("PSModulePath") else "bash"


def default_history_path(shell: str, env: Mapping[str, str] | None = None, home: str | None = None, platform: str = sys.platform) -> str:
    env = os.environ if env is None else env
    home = home or str(Path.home())
    if shell == "powershell":
        if platform == "win32":
            base = env.get("APPDATA") or os.path.join(home, "AppData", "Roaming")
            return os.path.join(base, "Microsoft", "Windows", "PowerShell", "PSReadLine", "ConsoleHost_history.txt")
        return os.path.join(home, ".local", "share", "powershell", "PSReadLine", "ConsoleHost_history.txt")
    return os.path.join(home, f".{shell}_history")


def history_path(shell: str, override: str | None = None, env: Mapping[str, str] | None = None, home: str | None = None, platform: str = sys.platform) -> tuple[str, str]:
    """Path and where it comes from: override, env or default."""
    env = os.environ if env is None else env
    if override:
        return os.path.abspath(override), "override"
    if shell in ("bash", "zsh") and env.get("HISTFILE"):
        return env["HISTFILE"], "env"
    return default_history_path(shell, env, home, platform), "default"


def known_history_paths(env: Mapping[str, str] | None = None, home: str | None = None, platform: str = sys.platform) -> dict[str, str]:
    return {s: default_history_path(s, env, home, platform) for s in SHELLS}
