r"""WARC archives: writing captures, reading records, and assembling transactions.

Writing gives each page a request, a response (or revisit) and a metadata record, which name the
response's id as concurrent-to.  Of equal payloads of at least ``least_bytes`` bytes the one with
the smallest page_id is stored; the others become revisits that refer to it.  The pages are stored
with a number for each row first, so that a row has one id whatever is computed again.  Only rows
whose payload may occur twice (a bounded bitmap of digests) are shuffled.  The archives are gzip files of
at most ``per_archive`` captures, written by Spark's text writer, so any folder that Spark can write
to will do; they have one gzip member a file.

Reading streams the raw bytes of each gzip archive through Spark's reader and unpacks them member by member,
so an archive of any size needs the memory of its largest record; plain archives are read whole, up to
2 GB each.  Records are cut by their Content-Length, and the payload's digest is computed from the bytes
read.  ``damage`` says what is wrong with a record, null if nothing: it ends before its Content-Length
("truncated"), its payload does not have the stated digest ("digest differs"; sha256, sha1 and md5 are
compared, in hex and in base32), it was unpacked from a gzip member that then fails ("damaged"; members that
unpack to more than 4 MB are handed on as they are read, so their damage shows in the row below alone), or no
record begins where one should ("no record", after which the rest of the archive is skipped).  Besides, each place at which
an archive cannot be unpacked gives a row without a record: "archive damaged", after which reading goes on at
the next member that begins with a record, or "archive breaks off" at its end.  So no record is lost without
a row that says so.  Errors of the storage fail the task.

Assembly joins the records of a capture through concurrent-to, in either direction and over all of
a record's concurrent-to fields, and gives one nested row per response or revisit; a revisit gets its
payload's length through the record that it refers to.  Targets of very many revisits are joined apart, by a
broadcast of at most ``_HOT`` rows, so no revisit's task grows with them.

White space and control characters in URLs are written as %20.  Null payloads count as empty; a null page_id comes after all others and stays null; rows that
repeat a page_id are separate captures, the later of which revisit the first.  Other columns of pages are
ignored, whatever their names.  An empty table gives an archive without records and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.bitset import BitSet
from loomlog.llm.cluster import small_batches, stored

VERSION = "WARC/1.1"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CUT = b"\x1f\x0e"  # two bytes that meet now and then in packed data
_MEMBER = b"\x1f\x8b\x08"
#: Hadoop's codec that passes bytes through, so that Spark's reader does not unpack: damage is seen and passed
#: here.  Its option has a second name in the Hadoop client that comes with Spark.
_AS_IS = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"} | {f"{p}io.compress.passthrough.extension": ".gz" for p in ("", "org.apache.hadoop.shaded.")}
_HELD = 4 << 20  # bytes of a member that are kept, packed, or held back, unpacked
_HOT = 10_000
_LEAST_HOT = 2_000
RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, page_id long, block_bytes long, payload_bytes long, payload_digest string, stated_digest string, method string, status int, damage string"


def _record_id(kind: str, page_id: Column, seq: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("-")), seq.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record(kind: Column, record_id: Column, date: str, lines: list[Column], content_type: str, block: Column, end: str = "\r\n\r\n") -> Column:
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", record_id),
        _line("WARC-Date", F.lit(date)),
        *lines,
        _line("Content-Type", F.lit(content_type)),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit(end),
    )


def _hot(counts: DataFrame) -> DataFrame:
    """Of (of, n) the keys that so many rows share that there can be at most _HOT of them."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.filter(F.col("n") > max(_LEAST_HOT, total / _HOT)).select("of")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z", per_archive: int = 50_000) -> None:
    """Write the pages (page_id, url, html) to gzip archives below ``path``."""
    html = F.coalesce("html", F.lit(""))
    rows = stored(
        pages.select(
            F.monotonically_increasing_id().alias("seq"),
            F.col("page_id").cast("long").alias("page_id"),
            F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20").alias("url"),
            html.alias("html"),
            F.sha2(html, 256).alias("digest"),
        ),
        "pages",
    )
    large = rows.filter(F.octet_length("html") >= least_bytes)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "seq")
    firsts = large.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    firsts = stored(firsts.select(F.col("digest").alias("of"), "n", F.col("first.page_id").alias("first_id"), F.col("first.seq").alias("first_seq")), "firsts")
    known = BitSet(firsts.select(F.xxhash64("of").alias("key")), "key")
    hot = _hot(firsts.select("of", "n"))
    hot_firsts, cold_firsts = firsts.join(F.broadcast(hot), "of", "left_semi"), firsts.join(F.broadcast(hot), "of", "left_anti")
    unique = known.part(rows, F.xxhash64("digest"), False).withColumns({"first_id": F.lit(None).cast("long"), "first_seq": F.lit(None).cast("long")})
    copies = known.part(rows, F.xxhash64("digest"), True)
    of_hot = copies.join(F.broadcast(hot_firsts.drop("n")), F.col("digest") == F.col("of"))
    of_cold = copies.join(F.broadcast(hot), F.col("digest") == F.col("of"), "left_anti").join(cold_firsts.drop("n"), F.col("digest") == F.col("of"), "left")
    r = unique.unionByName(of_hot.drop("of")).unionByName(of_cold.drop("of"))
    revisit = F.col("first_seq").isNotNull() & (F.col("first_seq") != F.col("seq"))
    page, seq = F.col("page_id"), F.col("seq")
    response_id = _record_id("response", page, seq)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    to = _line("WARC-Concurrent-To", response_id)
    uri = _line("WARC-Target-URI", F.col("url"))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    refers = F.when(revisit, F.concat(_line("WARC-Profile", F.lit(_REVISIT)), _line("WARC-Refers-To", _record_id("response", F.col("first_id"), F.col("first_seq"))))).otherwise(F.lit(""))
    response = _record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), response_id, date, [uri, digest, refers], "application/http; msgtype=response", F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html"))))
    request = _record(F.lit("request"), _record_id("request", page, seq), date, [uri, to], "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    note = F.coalesce(F.concat(F.lit("page-id: "), page.cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record(F.lit("metadata"), _record_id("metadata", page, seq), date, [uri, to], "application/warc-fields", note, end="\r\n\r")
    # The writer puts one line feed after each value: it is the last byte of the third record.
    r.select(F.concat(request, response, metadata).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)


def _headers(raw: bytes) -> dict[str, list[str]]:
    """Values of each header field, in order; names in lower case."""
    out: dict[str, list[str]] = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("utf-8", "replace"), []).append(value.strip().decode("utf-8", "replace"))
    return out


def records_of(stream) -> Iterator[tuple[dict[str, list[str]], bytes, str | None]]:
    """Header fields, block and damage of each record of an archive (anything with readline and read)."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            yield {}, b"", "no record"
            return
        raw = bytearray()
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            raw += line
        fields = _headers(bytes(raw))
        stated = fields.get("content-length", [""])[0]
        size = int(stated) if stated.isdecimal() else 0
        block = stream.read(size)
        yield fields, block, "truncated" if not line or not stated.isdecimal() or len(block) < size else None


def _next_member(held: bytes, chunks: Iterator[bytes]) -> bytes:
    """What is left from the next member on that begins with a record; empty if there is none."""
    at = 0
    while True:
        at = held.find(_MEMBER, at)
        if at < 0 or len(held) - at < 1 << 10:
            more = next(chunks, None)
            if more is not None:
                at = max(0, len(held) - len(_MEMBER) + 1) if at < 0 else at
                held, at = held[at:] + more, 0
                continue
            if at < 0:
                return b""
        try:
            if zlib.decompressobj(31).decompress(held[at : at + (1 << 12)], 5) == b"WARC/":
                return held[at:]
        except zlib.error:
            pass
        at += 1


def _unpacked(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, str | None]]:
    """Unpacked bytes of a gzip archive, and what is wrong with them; no bytes where an archive is damaged."""
    raw = b""
    while True:
        while len(raw) < len(_MEMBER) and (more := next(chunks, None)) is not None:
            raw += more
        if not raw.strip(b"\0"):  # padding
            more = next(chunks, None)
            if more is None:
                return
            raw = more
            continue
        kept, kept_size, out, size, wrong = [raw], len(raw), [], 0, None
        unpack, piece = zlib.decompressobj(31), raw
        while not wrong and not unpack.eof:
            try:
                data = unpack.decompress(piece, 1 << 20)
            except zlib.error:
                wrong = "archive damaged"
                break
            size += len(data)
            out.append(data)
            if size > _HELD:
                yield b"".join(out), None
                out = []
            if unpack.eof:
                raw = unpack.unused_data
            elif unpack.unconsumed_tail:
                piece = unpack.unconsumed_tail
            elif (piece := next(chunks, b"")) == b"":
                wrong = "archive breaks off"
            else:
                kept.append(piece)
                kept_size += len(piece)
                while kept_size - len(kept[0]) > _HELD:
                    kept_size -= len(kept.pop(0))
        if out:
            yield b"".join(out), "damaged" if wrong else None
        if wrong:
            yield b"", wrong
            raw = _next_member(b"".join(kept)[1:], chunks)
            if not raw:
                return


class _Archive:
    """A gzip archive as a stream that ends where it is damaged; ``go_on`` leads past that place.

    ``why`` says why the stream has ended, null at the end of the archive; ``bad`` what is wrong with bytes read.
    """

    def __init__(self, rows: Iterable[bytes]):
        self.parts = _unpacked(iter(rows))
        self.held, self.at, self.why, self.bad = b"", 0, None, None

    def go_on(self) -> None:
        self.held, self.at, self.why, self.bad = b"", 0, None, None

    def _next(self) -> bytes | None:
        if self.why:
            return None
        data, wrong = next(self.parts, (None, None))
        if data == b"" and wrong:
            self.why = wrong
            return None
        self.bad = wrong
        return data

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0:
            part = self._next()
            if part is None:
                end = len(self.held) - 1
                break
            self.held, self.at = self.held[self.at :] + part, 0
        out, self.at = self.held[self.at : end + 1], end + 1
        return out

    def read(self, size: int) -> bytes:
        parts = [self.held[self.at : self.at + size]]
        got = len(parts[0])
        self.at += got
        while got < size and (part := self._next()) is not None:
            parts.append(part[: size - got])
            self.held, self.at = part, len(parts[-1])
            got += self.at
        return b"".join(parts)


def _same_digest(stated: str, payload: bytes) -> bool | None:
    """Whether the payload has the stated digest; None for algorithms that are not compared."""
    name, _, value = stated.partition(":")
    if name.lower() not in ("sha256", "sha1", "md5"):
        return None
    digest = hashlib.new(name.lower(), payload, usedforsecurity=False).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def _row(fields: dict[str, list[str]], block: bytes, damage: str | None, with_payload: bool) -> dict:
    one = lambda name: fields.get(name, [None])[0]
    kind, stated = one("warc-type") or "", one("warc-payload-digest")
    out = {
        "record_id": one("warc-record-id"),
        "type": kind,
        "concurrent_to": fields.get("warc-concurrent-to", []),
        "refers_to": one("warc-refers-to"),
        "target_uri": one("warc-target-uri"),
        "date": one("warc-date"),
        "block_bytes": len(block),
        "stated_digest": stated and stated.removeprefix("sha256:"),
        "damage": damage,
    }
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        words = head.split(b"\r\n", 1)[0].split(b" ")
        out["status"] = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
        if kind == "response":
            out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
            if damage is None and stated and _same_digest(stated, payload) is False:
                out["damage"] = "digest differs"
            if with_payload:
                out["payload"] = payload
    elif kind == "request":
        out["method"] = block.split(b" ", 1)[0].decode("latin-1")
    elif kind == "metadata":
        page = _headers(block).get("page-id", [""])[0]
        out["page_id"] = int(page) if page.lstrip("-").isdecimal() else None
    return out


def _parse(with_payload: bool, cut: bool):
    types = {"concurrent_to": pa.list_(pa.string()), "page_id": pa.int64(), "block_bytes": pa.int64(), "payload_bytes": pa.int64(), "status": pa.int32(), "payload": pa.binary()}
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator:
        """A stream for each archive; rows of one archive follow one another."""
        if not cut:
            for batch in batches:
                for content in batch.column(1):
                    raw = content.as_buffer()
                    yield _Archive([raw.to_pybytes()]) if raw[:2].to_pybytes() == _MEMBER[:2] else io.BufferedReader(pa.BufferReader(raw))
            return
        rows = ((f.as_py(), row) for batch in batches for f, row in zip(batch.column(0), batch.column(1)))
        ahead = next(rows, None)

        def own(file: str) -> Iterator[bytes]:
            nonlocal ahead
            begun = b""
            while ahead is not None and ahead[0] == file:
                row, ahead = ahead[1].as_py(), next(rows, None)
                yield begun + row
                begun = _CUT  # the cuts are put back

        while ahead is not None:
            rest = own(ahead[0])
            yield _Archive(rest)
            for _ in rest:  # what an archive that is no archive has left
                pass

    def rows_of(stream) -> Iterator[tuple[dict, int]]:
        while True:
            for fields, block, damage in records_of(stream):
                yield _row(fields, block, damage or getattr(stream, "bad", None), with_payload), len(block)
            why = getattr(stream, "why", None)
            if why is None:
                return
            yield {"type": "", "concurrent_to": [], "block_bytes": 0, "damage": why}, 0
            stream.go_on()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for stream in archives(batches):
            for row, block in rows_of(stream):
                rows.append(row)
                size += block if with_payload else 200
                if size > 1 << 21:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives (*.gz and *.warc) at ``path``, and one per place where an archive is damaged."""
    small_batches(spark)
    schema = RECORD + ", payload binary" * with_payload
    packed = spark.read.options(**_AS_IS).option("lineSep", _CUT.decode()).option("pathGlobFilter", "*.gz").option("ignoreCorruptFiles", "false").text(path)
    streamed = packed.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("row")).mapInArrow(_parse(with_payload, True), schema)
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select("path", "content")
    return streamed.unionByName(plain.mapInArrow(_parse(with_payload, False), schema))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response, request, metadata (structs), and what it refers to.

    Of several requests or metadata records of a capture the one with the least id is shown, and
    n_request and n_metadata count them.
    """
    responses = records.filter(F.col("type").isin("response", "revisit"))
    nested = responses.select(F.col("record_id").alias("capture_id"), F.struct(*responses.columns).alias("response"))
    named = responses.select(F.col("record_id").alias("of"), F.explode("concurrent_to").alias("named"))

    def side(kind: str) -> DataFrame:
        rows = records.filter(F.col("type") == kind)
        to_response = rows.select(F.explode("concurrent_to").alias("of"), "*")
        from_response = rows.join(named, F.col("record_id") == F.col("named")).select("of", *rows.columns)
        pick = F.struct("record_id", "target_uri", "method", "page_id", "date", "damage")
        return to_response.unionByName(from_response).groupBy("of").agg(F.min(pick).alias(kind), F.count_distinct("record_id").alias(f"n_{kind}"))

    requests, notes = side("request"), side("metadata").withColumnRenamed("of", "of2")
    out = nested.join(requests, F.col("capture_id") == F.col("of"), "left").join(notes, F.col("capture_id") == F.col("of2"), "left").drop("of", "of2")
    known = F.struct(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"))
    targets = out.filter(F.col("response.type") == "response").select(F.col("capture_id").alias("target"), known.alias("found"))
    hot = _hot(responses.filter("refers_to IS NOT NULL").groupBy(F.col("refers_to").alias("of")).agg(F.count("*").alias("n")))
    hot_targets = targets.join(F.broadcast(hot), F.col("target") == F.col("of"), "left_semi").select(F.col("target").alias("hot"), F.col("found").alias("hot_found"))
    out = out.join(F.broadcast(hot_targets), F.col("response.refers_to") == F.col("hot"), "left")
    # Captures whose target is found already, or that have none, would all meet under null; their own ids spread them.
    key = F.coalesce(F.when(F.col("hot").isNull(), F.col("response.refers_to")), F.concat(F.lit("-"), F.col("capture_id")))
    return out.join(targets, key == F.col("target"), "left").withColumn("referred", F.coalesce("hot_found", "found")).drop("hot", "hot_found", "target", "found")
