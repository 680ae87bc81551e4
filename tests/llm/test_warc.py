"""Archives written and read back, hand-made and damaged ones, and assembly."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest

from loomlog.llm import warc
from loomlog.llm.warc import assemble, read_warc, write_warc

HTML = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n é\n\n</p>\n"


def record(kind, rid, block, *lines, version=b"WARC/1.1"):
    head = [version, b"WARC-Type: " + kind, b"WARC-Record-ID: " + rid, *lines, b"Content-Length: " + str(len(block)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(payload):
    return b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + payload


def write(path, *records, packed=True):
    path.write_bytes(b"".join(gzip.compress(r) for r in records) if packed else b"".join(records))


def brute(rows):
    """What the pages come to: per page id, payload size and digest, type, and the page it refers to."""
    best = {}
    for k, (i, _, h) in enumerate(rows):
        key = (i is None, i or 0, k)
        if len((h or "").encode()) >= 100:
            best[h] = min(best.get(h, key), key)
    out = []
    for k, (i, _, h) in enumerate(rows):
        raw = (h or "").encode()
        first = best.get(h)
        again = first is not None and first[2] != k
        out.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", str(rows[first[2]][0]) if again else "None"))
    return Counter(out)


def read_back(spark, path):
    got = []
    for r in assemble(read_warc(spark, path)).collect():
        own = r.response if r.response.type == "response" else r.referred
        got.append((str(r.metadata.page_id), own.payload_bytes, own.payload_digest, r.response.type, str(r.referred.page_id) if r.referred else "None"))
        assert r.response.damage is None and r.n_request == r.n_metadata == 1
        assert r.request.method == "GET" and r.response.status == 200
    return Counter(got)


@pytest.mark.parametrize("per_archive, least_hot", [(50_000, 2_000), (2, 1)])
def test_round_trip(spark, tmp_path, monkeypatch, per_archive, least_hot):
    monkeypatch.setattr(warc, "_LEAST_HOT", least_hot)
    rows = [(3, "http://a b", HTML), (1, "u", HTML), (2, None, None), (4, "u", "short"), (5, "u", "short"), (None, "u", HTML), (1, "u", HTML), (6, "u", "y" * 3_000_000), (7, "", "é" * 50), (8, "", "é" * 50), (9, "", "")]
    path = str(tmp_path / "w")
    write_warc(spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, seq int, digest string"), path, per_archive=per_archive)
    if per_archive == 2:
        assert len(list((tmp_path / "w").glob("*.gz"))) >= len(rows) // 2
    want = brute(rows)
    # of the rows that repeat page 1 either may come first
    assert read_back(spark, path) == want


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_warc(spark, path).count() == 0 and assemble(read_warc(spark, path)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_concurrent_to_in_either_direction_and_repeated(spark, tmp_path, packed):
    a = record(b"response", b"<a>", http(b"one"), b"WARC-Concurrent-To: <q>", b"WARC-Concurrent-To: <m>")
    b = record(b"response", b"<b>", http(b"two"))
    c = record(b"request", b"<c>", b"POST / HTTP/1.1\r\n\r\n", b"WARC-Concurrent-To: <x>", b"warc-concurrent-to:<b>")
    q = record(b"request", b"<q>", b"GET / HTTP/1.1\r\n\r\n")
    m = record(b"metadata", b"<m>", b"page-id: 7\r\n")
    info = record(b"warcinfo", b"<i>", b"x: y\r\n")
    write(tmp_path / ("a.warc.gz" if packed else "a.warc"), info, a, b, c, q, m, packed=packed)
    got = {r.capture_id: r for r in assemble(read_warc(spark, str(tmp_path))).collect()}
    assert set(got) == {"<a>", "<b>"}
    assert got["<a>"].request.record_id == "<q>" and got["<a>"].metadata.page_id == 7
    assert got["<b>"].request.method == "POST" and got["<b>"].metadata is None


@pytest.mark.parametrize("packed", [True, False])
def test_damaged_archives(spark, tmp_path, packed):
    ext = "warc.gz" if packed else "warc"
    good = record(b"response", b"<g>", http(b"good"), b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"good").hexdigest().encode())
    sha1 = record(b"response", b"<s>", http(b"good"), b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"good").digest()))
    other = record(b"response", b"<o>", http(b"good"), b"WARC-Payload-Digest: blake3:0")
    bad = record(b"response", b"<d>", http(b"good"), b"WARC-Payload-Digest: sha256:" + b"0" * 64)
    write(tmp_path / f"a.{ext}", good, sha1, other, bad, packed=packed)
    long = record(b"response", b"<t>", http(b"x" * 500)).replace(b"Content-Length: 525", b"Content-Length: 9999")
    write(tmp_path / f"b.{ext}", good.replace(b"<g>", b"<g2>"), long, packed=packed)
    write(tmp_path / f"c.{ext}", b"not an archive\r\n" * 5, good, packed=packed)
    write(tmp_path / f"d.{ext}", good.replace(b"<g>", b"<g3>"), b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <n>\r\n\r\n", packed=packed)
    got = {(r.record_id, r.damage) for r in read_warc(spark, str(tmp_path), with_payload=True).collect()}
    assert got == {("<g>", None), ("<s>", None), ("<o>", None), ("<d>", "digest differs"), ("<g2>", None), ("<t>", "truncated"), (None, "no record"), ("<g3>", None), ("<n>", "truncated")}


def noise(i, n=20_000):
    return random.Random(i).randbytes(n)


def members(n, per_member):
    records = [record(b"response", b"<%d>" % i, http(noise(i)), b"WARC-Payload-Digest: sha256:" + hashlib.sha256(noise(i)).hexdigest().encode()) for i in range(n)]
    return [gzip.compress(b"".join(records[i : i + per_member])) for i in range(0, n, per_member)]


def read_raw(spark, tmp_path, raw):
    (tmp_path / "a.warc.gz").write_bytes(raw)
    got = read_warc(spark, str(tmp_path)).collect()
    good = [r.record_id for r in got if r.damage is None]
    assert len(good) == len(set(good)) and all(r.payload_digest == hashlib.sha256(noise(int(r.record_id[1:-1]))).hexdigest() for r in got if r.damage is None)
    return good, [r.damage for r in got if r.damage is not None]


@pytest.mark.parametrize("per_member", [1, 30, 7])
@pytest.mark.parametrize("percent", [3, 30, 50, 66, 80, 95, 99.99])
def test_archive_that_breaks_off(spark, tmp_path, per_member, percent):
    raw = b"".join(members(30, per_member))
    good, damage = read_raw(spark, tmp_path, raw[: int(len(raw) * percent / 100)])
    assert damage[-1] == "archive breaks off" and len(damage) <= 1 + per_member
    # All that is lost lies in the member that breaks off or after it.
    at_least = int(30 * percent / 100) // per_member * per_member
    assert good[:at_least] == [f"<{i}>" for i in range(at_least)]


def test_archive_cut_between_members_is_whole(spark, tmp_path):
    assert read_raw(spark, tmp_path, b"".join(members(6, 2)[:2]) + b"\0" * 600) == (["<0>", "<1>", "<2>", "<3>"], [])


@pytest.mark.parametrize("per_member, lost", [(1, 1), (5, 5), (30, 30)])
def test_bytes_overwritten(spark, tmp_path, per_member, lost):
    packed = members(30, per_member)
    where = len(b"".join(packed)) // 2
    raw = bytearray(b"".join(packed))
    raw[where : where + 40] = b"\xff\x00" * 20
    good, damage = read_raw(spark, tmp_path, bytes(raw))
    assert 30 - lost - 1 <= len(good) < 30 and "archive damaged" in damage
    if per_member < 30:  # reading goes on at the next member
        assert "<29>" in good and "<0>" in good


def test_bad_members(spark, tmp_path):
    packed = members(12, 1)
    packed[2] = packed[2][:-5] + bytes([packed[2][-5] ^ 1]) + packed[2][-4:]  # length field
    packed[4] = packed[4][: len(packed[4]) // 2]
    packed[6] = b"no gzip at all" * 9
    packed[8] = b""
    good, damage = read_raw(spark, tmp_path, b"".join(packed))
    assert good == [f"<{i}>" for i in (0, 1, 3, 5, 7, 9, 10, 11)]
    assert damage.count("archive damaged") == 3


def test_records_of_a_bad_member_are_marked(spark, tmp_path):
    payload = random.Random(5).randbytes(3 << 20)
    bad = bytearray(gzip.compress(record(b"response", b"<0>", http(payload), b"WARC-Payload-Digest: crc:0") + record(b"response", b"<1>", http(payload[:9]))))
    bad[-6] ^= 1  # the check at the end of the member
    (tmp_path / "a.warc.gz").write_bytes(bytes(bad) + members(1, 1)[0])
    got = [(r.record_id, r.damage) for r in read_warc(spark, str(tmp_path)).collect()]
    assert got[0][0] == "<0>" and got[0][1] in ("damaged", "truncated") and (None, "archive damaged") in got and got[-1] == ("<0>", None)


def test_storage_errors_fail(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members(3, 1)))
    records = read_warc(spark, str(tmp_path))
    (tmp_path / "a.warc.gz").unlink()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|not exist|No such file"):
        records.collect()


@pytest.mark.parametrize("name, spell", [(n, f) for n in ("sha256", "sha1", "md5") for f in ("hex", "b32")])
def test_digests_in_either_spelling(name, spell):
    digest = hashlib.new(name, b"x").digest()
    stated = digest.hex() if spell == "hex" else base64.b32encode(digest).decode()
    assert warc._same_digest(f"{name}:{stated}", b"x") is True and warc._same_digest(f"{name}:{stated}", b"y") is False
    assert warc._same_digest("blake3:00", b"x") is None


def test_very_long_payload(spark, tmp_path):
    payload = b"line of a payload\n" * 500_000
    write(tmp_path / "a.warc.gz", record(b"response", b"<a>", http(payload)), record(b"response", b"<b>", http(b"")))
    got = {r.record_id: (r.payload_bytes, r.payload_digest) for r in read_warc(spark, str(tmp_path)).collect()}
    assert got == {"<a>": (len(payload), hashlib.sha256(payload).hexdigest()), "<b>": (0, hashlib.sha256(b"").hexdigest())}
