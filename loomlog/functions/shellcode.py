"""Code blocks in answers, and what shell code declares: folds over lines, as helpers of Arrow functions.

A declaration stands on one line; a heading that consists of marks alone is kept as it is.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

FENCE = "```"
#: Words that may head a block, before an optional number and a colon or full stop (fixed values).
HEADS = ("suggestion", "alias", "function", "script")
_NAME = re.compile(r"[A-Za-z0-9_-]+")
_QUOTES = "`\""


def _lines(code: str) -> list[str]:
    return re.split("\r\n|[\n\r  ]", code)


def _without_stars(text: str) -> str:
    """Up to two asterisks less at the begin, and white space after them."""
    return text[min(2, len(text) - len(text.lstrip("*"))) :].lstrip()


def _without_head(text: str) -> str:
    """Less one of the head words with its number and mark, if it begins so and more follows."""
    for word in HEADS:
        if text[: len(word)].lower() == word:
            rest = text[len(word) :].lstrip().lstrip("0123456789")
            if rest[:1] in (":", ".") and rest[:1]:
                return rest[1:]
    return text


def _heading(line: str, begins: bool) -> str | None:
    """What a line says about the block below it; None if it cannot head one.

    A line that ends with a quoted part is headed by that part.  The marks of a title (#, a head word)
    go only where the search begins with the line (``begins``), asterisks anywhere.
    """
    text = line.rstrip()
    if text[-1:] and text[-1] in _QUOTES:
        text = text[:-1]
    inner = max(text.rfind(q) for q in _QUOTES)
    if inner >= 0:
        return text[inner + 1 :] or None
    if not text.strip():
        return None
    if not begins or text[0].isspace():
        return _without_stars(text.lstrip()) or text[-1]
    marks = len(text) - len(text.lstrip("#"))
    rest = text[marks:].lstrip() if 1 <= marks <= 3 and text[marks : marks + 1].isspace() else text
    starred = rest[min(2, len(rest) - len(rest.lstrip("*"))) :]
    return _without_stars(_without_head(starred).lstrip()) or _without_stars(starred.lstrip()) or rest[-1:] or text.strip()


def headed_blocks(text: str | None) -> list[tuple[str, str]]:
    """Heading and code of each fenced block that stands below a line of text.

    A fold over lines: it remembers the last line that is not blank; a fence opens a block if that line can
    head it, and the block goes up to the next fence, wherever that stands.  What follows it is read on as
    if the text began there.
    """
    out: list[tuple[str, str]] = []
    text = text or ""
    at, heading = 0, None
    begins = True
    while (end := text.find("\n", at)) >= 0:
        line = text[at:end]
        opens = line.startswith(FENCE) and re.fullmatch("[A-Za-z0-9_]*", line[len(FENCE) :]) is not None
        close = text.find(FENCE, end + 1) if opens and heading is not None else -1
        if close >= 0:
            out.append((heading.strip(), text[end + 1 : close].strip()))
            at, heading, begins = close + len(FENCE), None, True
            continue
        if line.strip():
            heading = _heading(line, begins)
        begins, at = False, end + 1
    return out


def _after(line: str, word: str) -> str | None:
    """What follows a word and white space at the begin of a line."""
    rest = line[len(word) :]
    return rest.lstrip() if line.startswith(word) and rest[:1].isspace() else None


def _before(text: str | None, mark: str, spaced: bool = True) -> str | None:
    """The name at the begin of a text if the mark follows it."""
    found = _NAME.match(text or "")
    if not found:
        return None
    rest = text[found.end() :]
    return found[0] if (rest.lstrip() if spaced else rest).startswith(mark) else None


def _set_alias(code: str) -> str | None:
    """The name that a PowerShell command sets, wherever it stands."""
    words = re.split(r"(\s+)", code)
    for k in range(0, len(words) - 4, 2):
        if words[k].lower().endswith("set-alias") and words[k + 2].lower() == "-name" and (found := _NAME.match(words[k + 4])):
            return found[0]
    return None


def _first(names) -> str | None:
    return next((n for n in names if n), None)


def block_declares(code: str) -> tuple[str, str | None]:
    """Kind and name of the code of a headed block."""
    lines = _lines(code)
    if any(_after(x, "alias") is not None or x[:9].lower() == "set-alias" for x in lines):
        kind = "alias"
    else:
        kind = "script" if code.startswith("#!/") else "function"
    alias = _first(_before(rest, "=", spaced=False) for x in lines if (rest := _after(x, "alias")) and not rest.startswith("-"))
    return kind, alias or _first(found[0] for x in lines if (rest := _after(x, "function")) and (found := _NAME.match(rest)))


def code_declares(code: str) -> tuple[str, str | None]:
    """Kind and name of code that is an answer by itself."""
    lines = _lines(code)
    alias = _first(_before(_after(x, "alias"), "=") for x in lines) or _set_alias(code)
    if alias:
        return "alias", alias
    called = _first(_before(_after(x, "function"), "()") or _before(x, "()") for x in lines)
    function = called or _first(found[0] for x in lines if (rest := _after(x, "function")) and (found := _NAME.match(rest)))
    if function:
        return "function", function
    return ("script" if code.startswith("#!/") else "function"), None


def _struct(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


@F.pandas_udf(ArrayType(_struct("h", "c")))
def blocks_of(text: pd.Series) -> pd.Series:
    return text.map(headed_blocks)


def _declared(rule):
    def declares(code: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule(x or "") for x in code], columns=["kind", "name"])

    return F.pandas_udf(declares, _struct("kind", "name"))


declared_by_block, declared_by_code = _declared(block_declares), _declared(code_declares)
