"""Byte-pair encoding of many texts at once: words are cut, hashed and gathered as arrays.

The words of a batch of texts are found by classes of code points, which a table gives for a whole
array.  Equal words are encoded once: they are grouped by a hash, and every word is compared with
the first of its group, code point by code point.  Ids of words come from ``BpeTables``, which keeps those of
recent words.  The result equals ``BpeTables.encode`` of each text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from loomlog.llm.bpe import BpeTables
from loomlog.llm.textops import mix, powers

_BATCH = 1 << 19  # code points
_MOST_WORDS = 1 << 19  # in each of two generations
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
#: Endings that are words of their own after an apostrophe, by their letters (fixed values).
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
_CLASSES: list[np.ndarray] = []
_OF_WORD: dict[int, tuple[dict[str, bytes], dict[str, bytes]]] = {}


def _classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASSES:
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        own = np.full(len(points), _OTHER, dtype=np.uint8)
        for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _DIGIT), (r"\p{White_Space}+", _SPACE)):
            for m in regex.finditer(pattern, text):
                own[m.start() : m.end()] = kind
        out = np.full(0x110000, _OTHER, dtype=np.uint8)
        out[points] = own
        _CLASSES.append(out)
    return _CLASSES[0]


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of code points that end with white space."""
    kind = _classes()[points]
    word = kind != _SPACE
    differs = kind[1:] != kind[:-1]
    first, last = word.copy(), word.copy()
    alone = kind == _DIGIT
    first[1:] &= differs | alone[1:]
    last[:-1] &= differs | alone[:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    # An apostrophe that stands alone before a letter takes an ending with it.
    k = np.flatnonzero((points[starts] == 39) & (ends - starts == 1))
    k = k[kind[ends[k]] == _LETTER]
    if len(k):
        a, b = points[ends[k]], points[np.minimum(ends[k] + 1, len(points) - 1)]
        size = np.zeros(len(k), dtype=np.int64)
        for ending in _ENDINGS:
            size[(a == ord(ending[0])) & ((b == ord(ending[-1])) | (len(ending) == 1))] = len(ending)
        ends[k] += size
        k = k[size > 0]
        starts[k + 1] = ends[k]
        keep = starts < ends
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def _groups(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The first word of each group of equal words, and the group of each word; None if hashes collide."""
    pow_, inv = powers(len(points) + 1)
    acc = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(0x9E3779B9)) * pow_[: len(points)], out=acc[1:])
    size = ends - starts
    h = mix((acc[ends] - acc[starts]) * inv[starts] + size.astype(np.uint64))
    group = pa.array(h).dictionary_encode().indices.to_numpy()  # numbered as they come; hashed, not sorted
    firsts = np.zeros(int(group.max()) + 1, dtype=np.int64)
    firsts[group[::-1]] = np.arange(len(group))[::-1]
    like = firsts[group]
    if (size[like] != size).any():
        return None
    again = np.flatnonzero(like != np.arange(len(like)))  # a first word is itself
    n = size[again]
    place = np.arange(int(n.sum())) + np.repeat(starts[again] - (np.cumsum(n) - n), n)
    if (points[place] != points[place - np.repeat(starts[again] - starts[like[again]], n)]).any():
        return None
    return firsts, group


def _ids(t: BpeTables, words: list[str]) -> list[bytes]:
    """Ids of words; those met lately are kept, in two generations of a bounded size."""
    known, older = _OF_WORD.setdefault(id(t), ({}, {}))
    out = []
    for word in words:
        ids = known.get(word)
        if ids is None:
            ids = older.get(word)
            if ids is None:
                ids = np.array(t.encode_word(word), dtype="<u4").tobytes()
            if len(word) <= 64:
                if len(known) >= _MOST_WORDS:
                    known, older = {}, known
                    _OF_WORD[id(t)] = (known, older)
                known[word] = ids
        out.append(ids)
    return out


def _normal(text: str) -> str:
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # letters are lowered one by one, without regard to a word's end
    return text.lower()


def _encode_some(t: BpeTables, texts: list[str]) -> list[np.ndarray]:
    """Ids of normalised texts."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts, ends = _words(points)
    if not len(starts):
        return [np.zeros(0, dtype="<u4") for _ in texts]
    groups = _groups(points, starts, ends)
    if groups is None:
        found = _ids(t, [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        group = np.arange(len(starts))
    else:
        firsts, group = groups
        found = _ids(t, [joined[a:b] for a, b in zip(starts[firsts].tolist(), ends[firsts].tolist())])
    table = np.frombuffer(b"".join(found), dtype="<u4")
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    begin = np.cumsum(size) - size
    n = size[group]
    upto = np.cumsum(n)
    ids = table[np.arange(int(upto[-1])) + np.repeat(begin[group] - (upto - n), n)]
    edges = np.cumsum([0, *(len(x) + 1 for x in texts)])
    word = np.searchsorted(starts, edges)
    at = np.concatenate([[0], upto])[word]
    return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _encode_long(t: BpeTables, text: str) -> np.ndarray:
    """Ids of one normalised text, cut at white space."""
    parts, lo = [], 0
    while lo < len(text):
        hi = min(len(text), lo + _BATCH)
        if hi < len(text):
            m = regex.compile(r"\p{White_Space}").search(text, hi)
            hi = m.end() if m else len(text)
        parts += _encode_some(t, [text[lo:hi]])
        lo = hi
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


def encode_texts(t: BpeTables, texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end row, ids of each text as little-endian unsigned 32-bit integers) of runs of rows."""
    lo, held, size = 0, [], 0

    def close(hi: int) -> tuple[int, int, list[np.ndarray]]:
        out: list[np.ndarray | None] = [x if isinstance(x, np.ndarray) else None for x in held]
        plain = [k for k, x in enumerate(held) if isinstance(x, str)]
        for k, ids in zip(plain, _encode_some(t, [held[k] for k in plain])):
            out[k] = ids
        return lo, hi, out

    for k, x in enumerate(texts):
        text = x.as_py() or ""
        if t.special_pattern and any(s in text for s in t.special):
            held.append(np.frombuffer(t.encode(text), dtype="<u4"))
        elif len(text) > _BATCH:
            held.append(_encode_long(t, _normal(text)))
        else:
            held.append(_normal(text))
        size += len(text)
        if size >= _BATCH:
            yield close(k + 1)
            lo, held, size = k + 1, [], 0
    if held:
        yield close(lo + len(held))
