"""Scalar functions over command text, as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters between search tokens (fixed value).
TOKEN_SEPARATORS = r"""[\s/\-_.=|;:&"'`<>(){}\[\]]+"""
MAX_TYPO = 2
#: Weights of the search score, in order of evaluation (fixed values).
WEIGHTS = {"exact": 0.50, "fuzzy": 0.20, "substring": 0.20, "frequency": 0.05, "recency": 0.05}
RECENCY_WINDOW_MS = 30 * 24 * 60 * 60 * 1000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


#: What counts as white space at the ends of a line (fixed value).
WHITE = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def trim_all(c: Column) -> Column:
    """White space removed at both ends, line breaks included."""
    return F.trim(c, F.lit(WHITE))


def _astral(c: Column) -> Column:
    """Whether a text has characters of two UTF-16 units (four UTF-8 bytes)."""
    return (F.octet_length(c) > F.length(c)) & c.rlike("[\\x{10000}-\\x{10FFFF}]")


def utf16(c: Column) -> Column:
    """A text with one character for each UTF-16 unit of ``c``, equal where the units are.

    The two units of a character become two of the private planes; that plane's own characters have two
    units as well, so none is mistaken for another.
    """
    point = lambda ch: F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("long") - 0x10000
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    units = lambda ch: F.concat(char(F.lit(0xF0000) + F.shiftright(point(ch), 10)), char(F.lit(0xF0400) + point(ch).bitwiseAND(F.lit(1023).cast("long"))))
    spread = F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(F.octet_length(ch) == 4, units(ch)).otherwise(ch)), "")
    return F.when(_astral(c), spread).otherwise(c)


def utf16_length(c: Column) -> Column:
    return F.when(_astral(c), F.length(c) + F.length(F.regexp_replace(c, "[^\\x{10000}-\\x{10FFFF}]", ""))).otherwise(F.length(c))


def utf16_left(c: Column, n: int) -> Column:
    """The first n UTF-16 units; half a character at the end shows as the replacement character."""
    chars = F.split(c, "")
    step = lambda acc, ch: F.when(acc["left"] <= 0, acc).otherwise(
        F.struct(F.concat(acc["text"], F.when((F.octet_length(ch) == 4) & (acc["left"] == 1), F.lit("\ufffd")).otherwise(ch)).alias("text"), (acc["left"] - F.when(F.octet_length(ch) == 4, 2).otherwise(1)).alias("left"))
    )
    cut = F.aggregate(chars, F.struct(F.lit("").alias("text"), F.lit(n).alias("left")), step, lambda acc: acc["text"])
    return F.when(_astral(c), cut).otherwise(F.left(c, F.lit(n)))


def utf16_text(text: str) -> str:
    """``utf16`` of a text on the driver."""
    return "".join(ch if ord(ch) < 0x10000 else chr(0xF0000 + (ord(ch) - 0x10000 >> 10)) + chr(0xF0400 + (ord(ch) - 0x10000 & 1023)) for ch in text)


def cut_text(text: str, n: int) -> str:
    """``utf16_left`` of a text on the driver."""
    return text.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "replace")


def tokenize(c: Column) -> Column:
    """Lower-case tokens of a command or query."""
    return F.filter(F.split(F.lower(c), TOKEN_SEPARATORS), lambda t: t != "")


def tokenize_text(text: str) -> list[str]:
    import re

    return [t for t in re.split(TOKEN_SEPARATORS, text.lower()) if t]


def _literals(tokens: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in tokens]).cast("array<string>")


def exact_overlap(query: Sequence[str], tokens: Column) -> Column:
    """Share of query tokens (repeats count) that the command has."""
    if not query:
        return F.lit(0.0)
    return F.size(F.filter(_literals(query), lambda q: F.array_contains(tokens, q))) / F.lit(float(len(query)))


def fuzzy_overlap(query: Sequence[str], tokens: Column) -> Column:
    """Share of query tokens that the command lacks but for a typo; 1 if it lacks none."""
    if not query:
        return F.lit(0.0)
    tokens = F.transform(tokens, utf16)
    missing = F.filter(_literals([utf16_text(q) for q in query]), lambda q: ~F.array_contains(tokens, q))
    close = F.filter(missing, lambda q: F.exists(tokens, lambda t: (F.abs(F.length(t) - F.length(q)) <= MAX_TYPO) & (F.levenshtein(t, q, MAX_TYPO) >= 0)))
    return F.when(F.size(missing) == 0, F.lit(1.0)).otherwise(F.size(close) / F.lit(float(len(query))))


def substring_score(text: str, command: Column, query: Sequence[str], tokens: Column) -> Column:
    """1 if the command contains the query as typed, else the share of tokens that share a prefix."""
    partial = (
        F.size(F.filter(_literals(query), lambda q: F.exists(tokens, lambda t: F.startswith(t, q) | F.startswith(q, t)))) / F.lit(float(len(query)))
        if query
        else F.lit(0.0)
    )
    return F.when(F.contains(F.lower(command), F.lit(text.lower())), F.lit(1.0)).otherwise(partial)


def frequency_score(frequency: Column, most: Column) -> Column:
    return F.when(most <= 1, F.lit(0.0)).otherwise(F.ln(F.lit(1) + frequency) / F.ln(F.lit(1) + most))


def recency_score(used: Column, newest: Column) -> Column:
    """1 for the newest, falling to 0 over thirty days; 0 without a time."""
    age = (F.unix_millis(newest.cast("timestamp")) - F.unix_millis(used.cast("timestamp"))).cast("double")
    return F.when(used.isNull(), F.lit(0.0)).when(age <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(float(RECENCY_WINDOW_MS))))


def round3(score: Column) -> Column:
    """Three decimals, halves up."""
    return F.floor(score * 1000 + 0.5) / 1000.0


def capitalize(c: Column) -> Column:
    """First letter upper, the rest unchanged."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def truncate(c: Column, limit: int) -> Column:
    return F.when(utf16_length(c) <= limit, c).otherwise(F.concat(utf16_left(c, max(limit - 3, 0)), F.lit("...")))


def escape_markdown(c: Column) -> Column:
    """Bars and backticks escaped, line feeds as spaces."""
    return F.replace(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("`"), F.lit("\\`")), F.lit("\n"), F.lit(" "))


def percent(score: Column) -> Column:
    return F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def wrap_text(text: str, width: int) -> list[str]:
    """Greedy word wrap; longer words stay whole; no words give one empty line."""
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return lines or [""]
