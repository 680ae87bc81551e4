"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Encoding: an Aho-Corasick automaton over all tokens gives the longest token that begins at each
place of a pre-token.  The encoder goes from left to right, tries the longest token and then its
shorter prefixes, and accepts one only if the pair with the token before could stand side by side
in a merge result (the pair-compatibility table).  A place from which nothing fits is marked, so it
is tried once only: time is linear in the pre-token.  The result equals applying the merges by rank.

Decoding: the token strings lie one after another in one byte table; the ids select ranges of it.

Works on the tokenizer files of the `tokenizers` library that have a BPE model with an end-of-word
suffix, byte-level letters, and an NFC, white-space and lower-case normaliser.  Null texts count as
empty and have no tokens; a text or a single word may have any length; rows that repeat are encoded
each; an empty table gives an empty result.  Columns other than doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomlog.llm.cluster import small_batches

_END = chr(256)
_TABLES: dict[str, BpeTables] = {}
_CACHE = 1 << 18  # words
_PAIRS = 1 << 17


def _byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(extra)] = b
            extra += 1
    return out


class BpeTables:
    """What encoding and decoding need of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        vocab = model["vocab"]
        self.parts: dict[int, tuple[int, int]] = {i: (i, i) for i in vocab.values()}
        self.joined: dict[tuple[int, int], int] = {}
        # Ids of merge results may be in any order; what counts is the merge's rank.
        rank_of: dict[int, int] = {}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        base = len(vocab)
        for rank, (a, b) in enumerate(pairs):
            left = a[: -len(suffix)] if suffix and a.endswith(suffix) else a
            whole = vocab[left + b]
            if whole not in rank_of:
                rank_of[whole] = base + rank
                self.parts[whole] = (vocab[a], vocab[b])
            self.joined.setdefault((vocab[a], vocab[b]), whole)
        self.rank = {i: rank_of.get(i, i - base) for i in vocab.values()}
        self.pair_ok: dict[int, bool] = {}

        def text_of(token: str) -> str:
            end = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if end else token
            return "".join(chr(letters[c]) for c in body) + _END * end

        texts = {i: text_of(t) for t, i in vocab.items()}
        reachable: set[int] = set()
        for i in sorted(texts, key=self.rank.__getitem__):
            a, b = self.parts[i]
            if a == i or (a in reachable and b in reachable and self._side_by_side(a, b, self.rank[i])):
                reachable.add(i)
        self.automaton = ahocorasick.Automaton()
        by_text = {}
        for i in reachable:
            by_text[texts[i]] = i
            self.automaton.add_word(texts[i], (len(texts[i]), i))
        self.automaton.make_automaton()
        self.length = {i: len(texts[i]) for i in reachable}
        self.shorter: dict[int, int] = {}
        for i in reachable:
            t = texts[i]
            for n in range(len(t) - 1, 0, -1):
                if (s := by_text.get(t[:n])) is not None:
                    self.shorter[i] = s
                    break
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pieces = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _side_by_side(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether merging could leave a and b unmerged up to ``limit`` (a rank; None: for good)."""
        rank, parts, joined = self.rank, self.parts, self.joined
        bound = 1 << 40 if limit is None else limit
        while True:
            whole = joined.get((a, b))
            if whole is not None and rank[whole] < bound:
                return False
            # Undo the later of the two merges; of equal ones the right token's came second.
            if rank[a] > rank[b] and parts[a][0] != a or parts[b][0] == b and parts[a][0] != a:
                bound, a = rank[a], parts[a][1]
            elif parts[b][0] != b:
                bound, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.pair_ok.get(key)
        if ok is None:
            if len(self.pair_ok) >= _PAIRS:
                self.pair_ok.clear()
            ok = self.pair_ok[key] = self._side_by_side(a, b)
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        text = word.encode("utf-8").decode("latin-1") + _END
        n = len(text)
        longest: list[int] = [-1] * n
        size = [0] * n
        for end, (length, token) in self.automaton.iter(text):
            at = end - length + 1
            if length > size[at]:
                size[at], longest[at] = length, token
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            before = out[-1] if out else -1
            while token >= 0:
                end = pos + self.length[token]
                if not dead[end] and (before < 0 or self.compatible(before, token)):
                    break
                token = self.shorter.get(token, -1)
            if token >= 0:
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary does not cover this text")
                dead[pos] = 1
                token = out.pop()
                pos -= self.length[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        pieces = self.special_pattern.split(text) if self.special_pattern and any(t in text for t in self.special) else [text]
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
                continue
            if not piece.isascii():
                if not unicodedata.is_normalized("NFC", piece):
                    piece = unicodedata.normalize("NFC", piece)
                piece = piece.replace("Σ", "σ")  # letters are lowered one by one, without regard to a word's end
            words = self.words.findall(piece.lower())
            for lo in range(0, len(words), 1 << 16):
                some = words[lo : lo + (1 << 16)]
                ids = list(map(self.known.get, some))
                if None in ids:
                    for k in [k for k, x in enumerate(ids) if x is None]:
                        ids[k] = self._fetched(some[k])
                out.extend(ids)
        return b"".join(out)

    def _fetched(self, word: str) -> bytes:
        """Ids of a word that the younger half of the cache lacks; it moves there."""
        ids = self.known.get(word) or self.older.get(word)
        if ids is None:
            ids = np.array(self.encode_word(word), dtype="<u4").tobytes()
        if len(word) <= 64:
            if len(self.known) >= _CACHE // 2:  # words that did not occur since the last change go
                self.older, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by one space, in UTF-8 (what a file without a decoder asks for)."""
        if not len(ids):
            return b""
        begin = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(size)
        index = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return self.bytes[index[:-1]].tobytes()


def tables(path: str) -> BpeTables:
    """Tables of a file, built once per Python process."""
    if path not in _TABLES:
        _TABLES[path] = BpeTables(path)
    return _TABLES[path]


def _encode_batches(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(path)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 256):
                n_tokens, id_digests, text_digests, id_lists = [], [], [], []
                for text in texts.slice(lo, 256):
                    raw = t.encode(text.as_py() or "")
                    ids = np.frombuffer(raw, dtype="<u4")
                    decoded = hashlib.sha256()
                    for i in range(0, len(ids), 1 << 16):
                        decoded.update((b" " if i else b"") + t.decode(ids[i : i + (1 << 16)]))
                    n_tokens.append(len(ids))
                    id_digests.append(hashlib.sha256(raw).hexdigest())
                    text_digests.append(decoded.hexdigest())
                    if with_ids:
                        id_lists.append(ids.astype(np.int32))
                arrays = [batch.column(0).slice(lo, 256), pa.array(n_tokens, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array(id_lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def bpe_encode(docs: DataFrame, tokenizer: str, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    docs: doc_id, text.  tokenizer: path of the tokenizer file on every executor.  Returns doc_id,
    n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(_encode_batches(tokenizer, with_ids), schema)


def bpe_decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the decoded text of doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(tokenizer)
        for batch in batches:
            texts = [t.decode(np.array(x.as_py() or [], dtype=np.int64)).decode("utf-8") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
