r"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame operations only.

Each kind of personal data is found by a pattern and validated; what is valid is permuted inside
its own format, so equal values get equal pseudonyms in all documents, different values different
ones, and the text around stays as it is.

* card numbers (13 to 19 digits, or groups of 4-4-4-4 or 4-6-5, Luhn-valid): the digits before the check digit are permuted and
  the check digit is computed anew; separators stay.
* phone numbers with an area code in brackets: the digits after the country code.
* social security numbers (valid area, group and serial): area against group and serial.
* IPv4 addresses: the two halves of the 32 bits.
* calendar dates (yyyy-mm-dd and dd/mm/yyyy, 1800 to 2199): the day's number in the Gregorian
  400-year cycle of 189 * 773 days.
* secrets of at least 32 hex digits: the two halves of the whole string, of any length, so secrets
  that begin alike do not stay so; digits count by value, and where a letter is upper case all letters
  of the pseudonym are.
* e-mail addresses have no numeric format: the local part becomes 16 hex digits of a keyed hash,
  under the reserved domain example.invalid.

A Feistel network here has ten rounds: in turn one half is shifted, modulo its own size, by a keyed
SHA-256 of the other, which is a permutation for halves of any two sizes.  Invalid look-alikes are
left alone.  Null texts give null and no values; texts may have any length; rows that repeat are
changed alike; an empty table gives an empty result.  The other columns are kept; an input column
called n_pseudonyms becomes n_pseudonyms_input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.cluster import make_room

ROUNDS = 10

EMAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])"
ISO_DATE = r"(?<![0-9-])(?:1[89]|2[01])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])"
DAY_DATE = r"(?<![0-9/])(?:0[1-9]|[12][0-9]|3[01])/(?:0[1-9]|1[0-2])/(?:1[89]|2[01])[0-9]{2}(?![0-9/])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
KINDS = {"email": EMAIL, "secret": SECRET, "iso_date": ISO_DATE, "day_date": DAY_DATE, "ip": IPV4, "phone": PHONE, "ssn": SSN, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

_FIRST_DAY = "1800-01-01"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def _keyed(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Column:
    """Permutation of the pairs (left, right) with 0 <= left < left_size, 0 <= right < right_size."""

    def turn(acc: Column, i: Column) -> Column:
        a, b = acc["a"], acc["b"]
        return F.when(i % 2 == 0, F.struct(F.pmod(a + F.pmod(_keyed(key, tweak, i, b), left_size), left_size).alias("a"), b.alias("b"))).otherwise(
            F.struct(a.alias("a"), F.pmod(b + F.pmod(_keyed(key, tweak, i, a), right_size), right_size).alias("b"))
        )

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power10(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Permutation of the digit strings of one length (2 to 36 digits)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    pair = feistel(F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1, v).cast("long"), _power10(u), _power10(v), key, F.concat(tweak, n.cast("string")))
    return _let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, F.lit("0")), F.lpad(p["b"].cast("string"), v, F.lit("0"))))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit has weight one."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, F.lit(9)).otherwise(F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _lay_out(shape: Column, digits: Column) -> Column:
    """``digits`` put in the place of the digits of ``shape``."""
    chars = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    merged = F.aggregate(
        chars,
        start,
        lambda acc, c: F.when(
            c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
    )
    return merged["out"]


def card_pseudonym(s: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        check = lambda body: F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        body = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card"))
        new = _let(body, lambda b: F.concat(b, check(b).cast("string")))
        return F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, _let(new, lambda d: _lay_out(s, d))).otherwise(s)

    return _let(_only_digits(s), of)


def phone_pseudonym(s: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        country = F.substr(digits, F.lit(1), F.length(digits) - 10)
        new = F.concat(country, permute_digits(F.substr(digits, F.length(digits) - 9, F.lit(10)), key, F.concat(F.lit("phone"), country)))
        return _let(new, lambda d: _lay_out(s, d))

    return _let(_only_digits(s), of)


def ssn_pseudonym(s: Column, key: str) -> Column:
    area, group, serial = F.substring(s, 1, 3).cast("long"), F.substring(s, 5, 2).cast("long"), F.substring(s, 8, 4).cast("long")
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    new_area = lambda a: F.when(a >= 665, a + 2).otherwise(a + 1)
    return _let(pair, lambda p: F.concat_ws("-", pad(new_area(p["a"]), 3), pad(F.floor(p["b"] / 9999) + 1, 2), pad(F.pmod(p["b"], F.lit(9999)) + 1, 4)))


def ip_pseudonym(s: Column, key: str) -> Column:
    octet = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    pair = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    two = lambda c: [F.floor(c / 256).cast("string"), F.pmod(c, F.lit(256)).cast("string")]
    return _let(pair, lambda p: F.concat_ws(".", *two(p["a"]), *two(p["b"])))


def date_pseudonym(s: Column, fmt: str, key: str) -> Column:
    day = F.to_date(F.try_to_timestamp(s, F.lit(fmt)))
    n = F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long")
    p = feistel(F.floor(n / 773), F.pmod(n, F.lit(773)), F.lit(189), F.lit(773), key, F.lit("date"))
    new = F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["a"] * 773 + p["b"]).cast("int"))
    return F.when(n.between(0, 189 * 773 - 1), F.date_format(new, fmt)).otherwise(s)


def secret_pseudonym(s: Column, key: str) -> Column:
    """A Feistel network over the halves of a hex string, each in blocks of up to 15 digits."""
    low = F.lower(s)
    n = F.length(s)
    u = F.floor(n / 2).cast("int")

    def blocks(start: Column, size: Column) -> Column:
        """(value, digits) of each block of a half."""
        step = F.sequence(F.lit(0), (F.ceil(size / 15) - 1).cast("int"))
        width = lambda j: F.least(F.lit(15), size - j * 15)
        return F.transform(step, lambda j: F.struct(F.conv(F.substr(low, start + j * 15 + 1, width(j)), 16, 10).cast("long").alias("x"), width(j).alias("w")))

    def shifted(half: Column, other: Column, i: Column) -> Column:
        said = F.array_join(F.transform(other, lambda o: o["x"].cast("string")), ",")

        def block(o: Column, j: Column) -> Column:
            size = F.pow(F.lit(16.0), o["w"]).cast("long")
            return F.struct(F.pmod(o["x"] + F.pmod(_keyed(key, F.lit("hex"), n, i, j, said), size), size).alias("x"), o["w"].alias("w"))

        return F.transform(half, block)

    def turn(acc: Column, i: Column) -> Column:
        even = F.struct(shifted(acc["a"], acc["b"], i).alias("a"), acc["b"].alias("b"))
        return F.when(i % 2 == 0, even).otherwise(F.struct(acc["a"].alias("a"), shifted(acc["b"], acc["a"], i).alias("b")))

    start = F.struct(blocks(F.lit(0), u).alias("a"), blocks(u, n - u).alias("b"))
    shown = lambda half: F.array_join(F.transform(half, lambda o: F.lpad(F.lower(F.hex(o["x"])), o["w"], F.lit("0"))), "")
    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    out = _let(end, lambda p: F.concat(shown(p["a"]), shown(p["b"])))
    return F.when(s.rlike("[A-F]"), F.upper(out)).otherwise(out)


def email_pseudonym(s: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(s)), 256), 1, 16), F.lit("@example.invalid"))


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of a match of ``ANY``; what is not valid stays."""
    full = lambda kind: s.rlike("^(?:" + KINDS[kind] + r")\z")
    return (
        F.when(s.contains("@"), email_pseudonym(s, key))
        .when(full("ip"), ip_pseudonym(s, key))
        .when(full("iso_date"), date_pseudonym(s, "yyyy-MM-dd", key))
        .when(full("day_date"), date_pseudonym(s, "dd/MM/yyyy", key))
        .when(full("phone"), phone_pseudonym(s, key))
        .when(full("ssn"), ssn_pseudonym(s, key))
        .when(full("card"), card_pseudonym(s, key))
        .when(full("secret"), secret_pseudonym(s, key))
        .otherwise(s)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the number of values changed in n_pseudonyms.

    key: any secret string; the same key gives the same pseudonyms in every run.
    """
    docs = make_room(docs, "n_pseudonyms")
    t = F.col(f"`{text}`")
    found = F.when(t.rlike("[0-9@]|[a-fA-F]{32}"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def rebuilt(found: Column, new: Column) -> Column:
        parts = F.zip_with(F.split(t, ANY, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
        return F.struct(F.array_join(parts, "").alias("text"), changed.cast("long").alias("n"))

    def of(found: Column) -> Column:
        unchanged = F.struct(t.alias("text"), F.lit(0).cast("long").alias("n"))
        return F.when(F.size(found) > 0, _let(F.transform(found, lambda m: pseudonym(m, key)), lambda new: rebuilt(found, new))).otherwise(unchanged)

    rest = [c for c in docs.columns if c != text]
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _let(found, of).alias("result"))
    changed = {text: F.col("result.text")} | {c: F.col(f"row.`{c}`") for c in rest}
    return both.select(*[changed[c].alias(c) for c in docs.columns], F.coalesce("result.n", F.lit(0).cast("long")).alias("n_pseudonyms"))
