"""The last lines of text files, read backwards from their ends.

A Python data source with one partition for each file.  It reads blocks from the end, twice as
large each time, until they hold the lines asked for; what lies before them is never read.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomlog.sources.history import DEFAULT_LINES, LEAST_LINES, scan_lines, tail_lines

FIRST_BLOCK = 1 << 16
SCHEMA = "source string, n_lines long, line_idx long, raw string"


def last_lines(read_at, size: int, keep: int, block: int = FIRST_BLOCK) -> list[bytes]:
    """The last ``keep`` lines of a file of ``size`` bytes; read_at(offset, n) gives n bytes of it.

    Lines end at LF or CR LF; what follows the last break is a line, empty or not.
    """
    parts: list[bytes] = []
    at, breaks = size, 0
    while at and breaks < keep:
        n = min(block, at)
        at, block = at - n, 2 * block
        parts.append(read_at(at, n))
        breaks += parts[-1].count(b"\n")
    lines = b"".join(reversed(parts)).split(b"\n")[-keep:]
    return [x[:-1] if x.endswith(b"\r") else x for x in lines[:-1]] + lines[-1:]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there; ValueError or the like if it is not known here."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def files_of(path: str) -> list[str]:
    """The files at a path: one file, those of a folder, or those that a pattern of local names finds."""
    if "://" not in path and glob.has_magic(path):
        return sorted(p for p in glob.glob(path) if os.path.isfile(p))
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(scheme + x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.keep = options["path"], int(options["lines"])

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in files_of(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, at = _open(partition.path)
        with system.open_input_file(at) as f:

            def read_at(offset: int, n: int) -> bytes:
                f.seek(offset)
                return f.read(n)

            f_size = f.size()
            lines = last_lines(read_at, f_size, self.keep)
        for k, line in enumerate(lines if f_size else []):  # Spark's readers skip empty files
            yield partition.path, len(lines), k, line.decode("utf-8", "replace")


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomlog_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tail(spark: SparkSession, path: str, max_lines: int | None = DEFAULT_LINES) -> DataFrame:
    """The last lines of each file (at least 100), with line_idx from 0 within them.

    Paths that only Spark can open are scanned whole instead; the lines are the same, but for the numbers in line_idx.
    """
    keep = max(max_lines if max_lines is not None else DEFAULT_LINES, LEAST_LINES)
    try:
        files_of(path)
    except FileNotFoundError:
        raise
    except (OSError, ValueError, NotImplementedError):  # pyarrow has no such file system
        return tail_lines(scan_lines(spark, path), keep).drop("line_number")
    spark.dataSource.register(TailSource)
    return spark.read.format(TailSource.name()).option("lines", keep).load(path)
