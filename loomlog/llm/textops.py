"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes other than space, TAB, LF, VT, FF and CR.  Every function works on
the UTF-8 bytes of whole texts; a text of any length is hashed in pieces that end at a separator,
so that the scratch memory does not grow with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = b" \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 19
_SLICE = 1 << 19
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2**64."""
    kept = _POW.get(0)
    if kept is None or len(kept[0]) < n:
        size = max(n, _PIECE + 1)
        kept = (_powers(size, _BASE), _powers(size, _BASE_INV))
        if size <= 4 * _PIECE:
            _POW[0] = kept
    return kept


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the int64 offsets of the texts of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = _SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one row."""
    data, offsets = bytes_of(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _hash_piece(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word; ``begins`` are offsets at which a text begins."""
    word = ~_IS_SEP[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = begins[begins < len(data)]
    first[at] = word[at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    at = begins[(begins > 0) & (begins <= len(data))] - 1
    last[at] = word[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    pow_, inv = powers(len(data) + 1)
    acc = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * pow_[: len(data)], out=acc[1:], dtype=np.uint64)
    h = (acc[ends] - acc[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), starts, ends


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end byte of every word, and the offsets of each text's words.

    With ``lower``, A-Z count as a-z.
    """
    parts, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + _PIECE)
        if hi < len(data):
            back = np.flatnonzero(_IS_SEP[data[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:  # one word longer than a piece: go on to where it ends
                size = _PIECE
                while hi < len(data) and not len(back):
                    back = np.flatnonzero(_IS_SEP[data[hi : hi + size]])
                    hi, size = (hi + int(back[0]) + 1, size) if len(back) else (min(len(data), hi + size), size)
        piece = data[lo:hi]
        begins = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
        h, s, e = _hash_piece(LOWER_ASCII[piece] if lower else piece, begins)
        parts.append((h, s + lo, e + lo))
        lo = hi
    if parts:
        h, s, e = (np.concatenate(x) for x in zip(*parts))
    else:
        h, s, e = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return h, s, e, np.searchsorted(s, offsets)


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which run_hash takes the hash of any run of words."""
    acc = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(len(hashes) + 1)[0][: len(hashes)], out=acc[1:], dtype=np.uint64)
    return acc


def run_hash(acc: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the words from starts to ends, wherever in the text they stand."""
    inv = powers(len(acc))[1]
    h = (acc[ends] - acc[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt))


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sort_within(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order of the rows by document, then hash (both unsigned or non-negative)."""
    order = np.argsort(h)
    key = doc[order]
    if len(doc) and int(doc.max()) < 1 << 16:
        key = key.astype(np.uint16)  # sorted by radix
    return order[np.argsort(key, kind="stable")]
