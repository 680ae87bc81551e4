"""Pseudonyms against a plain version over whole texts, their properties, and edge cases."""

import datetime
import hashlib

import pytest
import regex
from pyspark.sql import functions as F
from test_llm import DIR, EDGE, SCHEMA

from loomlog.llm import pii

KEY = "k"
FIRST = datetime.date(1800, 1, 1)


def keyed(*parts):
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:15], 16)


def feistel(a, b, size_a, size_b, tweak):
    for i in range(10):
        if i % 2 == 0:
            a = (a + keyed(tweak, i, b)) % size_a
        else:
            b = (b + keyed(tweak, i, a)) % size_b
    return a, b


def permuted(digits, tweak):
    n = len(digits)
    u = n // 2
    a, b = feistel(int(digits[:u]), int(digits[u:]), 10**u, 10 ** (n - u), f"{tweak}{n}")
    return f"{a:0{u}d}{b:0{n - u}d}"


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d * 2 > 9) for i, d in enumerate(map(int, reversed(digits)))) % 10


def laid_out(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def secret(s):
    n, low = len(s), s.lower()
    halves = []
    for half in (low[: n // 2], low[n // 2 :]):
        halves.append([(int(half[j : j + 15], 16), len(half[j : j + 15])) for j in range(0, len(half), 15)])
    for i in range(10):
        mine, other = halves[i % 2], halves[1 - i % 2]
        said = ",".join(str(x) for x, _ in other)
        halves[i % 2] = [((x + keyed("hex", n, i, j, said) % 16**w) % 16**w, w) for j, (x, w) in enumerate(mine)]
    out = "".join(f"{x:0{w}x}" for half in halves for x, w in half)
    return out.upper() if regex.search("[A-F]", s) else out


def brute(m):
    is_ = lambda kind: regex.fullmatch(pii.KINDS[kind], m)
    digits = "".join(c for c in m if c in "0123456789")
    if "@" in m:
        return "u" + hashlib.sha256(f"{KEY}|email|{m.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    if is_("ip"):
        o = [int(x) for x in m.split(".")]
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    for kind, fmt in (("iso_date", "%Y-%m-%d"), ("day_date", "%d/%m/%Y")):
        if is_(kind):
            try:
                n = (datetime.datetime.strptime(m, fmt).date() - FIRST).days
            except ValueError:
                return m
            a, b = feistel(n // 773, n % 773, 189, 773, "date")
            return (FIRST + datetime.timedelta(days=a * 773 + b)).strftime(fmt)
    if is_("phone"):
        country = digits[:-10]
        return laid_out(m, country + permuted(digits[-10:], "phone" + country))
    if is_("ssn"):
        area, group, serial = (int(x) for x in m.split("-"))
        a, b = feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if is_("card"):
        if luhn(digits):
            return m
        body = permuted(digits[:-1], "card")
        return laid_out(m, body + str((10 - luhn(body + "0")) % 10))
    return secret(m) if is_("secret") else m


def brute_text(text):
    n = 0

    def put(m):
        nonlocal n
        new = brute(m.group())
        n += new != m.group()
        return new

    return (None, 0) if text is None else (regex.sub(pii.ANY, put, text), n)


LINE = "a.b@c.example.com 10.2.3.4 2024-02-29 29/02/2023 31/12/1999 +1 (212) 555-0100 123-45-6789 667-01-0001 4111111111111111 4111-1111-1111-1111 3782 822463 10005 4111111111111112 000-12-3456 1.2.3.4.5 " + "0a" * 20 + " " + "aB3" * 15


def test_against_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()] + [t for _, t in EDGE] + [LINE, "x" + LINE + "\n" + LINE]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    got = {r.k: (r.text, r.n_pseudonyms) for r in pii.pseudonymise(df, KEY).collect()}
    assert got == {k: brute_text(t) for k, t in enumerate(texts)}
    assert got[len(texts) - 2][1] == 12


def test_linked_across_documents_and_valid(spark):
    a, b = pii.pseudonymise(spark.createDataFrame([(1, LINE), (2, "again " + LINE)], "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert b.text == "again " + a.text
    for left in ("4111111111111112", "000-12-3456", "29/02/2023", "1.2.3.4.5"):
        assert left in a.text
    assert luhn(regex.search(r"\d{16}", a.text).group()) == 0


@pytest.mark.parametrize("secret", ["0a" * 64 + "7", "9f" * 500, "aB" * 20, "f" * 32])
def test_secrets_of_any_length_and_letter_case(spark, secret):
    other = secret[:-1] + ("0" if secret[-1] != "0" else "1")
    row, near = pii.pseudonymise(spark.createDataFrame([(1, f"key {secret} end"), (2, f"key {other} end")], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new, new_other = row.text.split(" ")[1], near.text.split(" ")[1]
    assert row.n_pseudonyms == 1 and len(new) == len(secret) and row.text == f"key {new} end"
    assert not set(new.lower()) - set("0123456789abcdef")
    assert sum(x == y for x, y in zip(new, new_other)) < len(new) / 2  # no part shows that the secrets begin alike


def test_permutations(spark):
    assert spark.range(10000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 4, "0"), "k", F.lit("t"))).distinct().count() == 10000
    days = spark.range(0, 146097, 7).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii.date_pseudonym(F.col("d"), "yyyy-MM-dd", "k")).distinct().count() == days.count()
    hexes = spark.range(2000).select(F.lpad(F.lower(F.hex("id")), 33, "0").alias("h"))
    assert hexes.select(pii.secret_pseudonym(F.col("h"), "k")).distinct().count() == 2000


def test_no_column_is_lost(spark):
    df = spark.createDataFrame([(1, "1.2.3.4", 7, "r", 8, 9)], "doc_id long, text string, n_pseudonyms int, _result string, row int, result int")
    out = pii.pseudonymise(df, "k")
    assert out.columns == ["doc_id", "text", "n_pseudonyms_input", "_result", "row", "result", "n_pseudonyms"]
    assert out.first()[2:] == (7, "r", 8, 9, 1)
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.pseudonymise(empty, "k").count() == 0


def test_query(spark):
    from loomlog.llm.queries import queries

    global KEY
    KEY, before = "loomlog", KEY
    try:
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
        got = {r.doc_id: (r.text, r.n_pseudonyms) for r in queries()["op3_pii"](spark, DIR).collect()}
        assert got == {i: brute_text(t) for i, t in docs.items()}
    finally:
        KEY = before
