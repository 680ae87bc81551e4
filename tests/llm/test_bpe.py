"""The encoder against the tokenizers library over whole texts, round trips, and edge cases."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from test_llm import DIR, EDGE, SCHEMA
from tokenizers import Tokenizer

from loomlog.llm import bpe
from loomlog.llm.bpe import bpe_decode, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")
EXTRA = ["<|endoftext|>hi <|startoftext|>", "ΑΣ İ ﬁ é don't we'LL 日本 😀 \x85 \x1c", None, "  ", "ab" * 40_000, "x1y2" * 5000, "ȩ́ ﬃ ǅ ẞ", "<|endoftext|>" * 50]


@pytest.fixture(scope="module")
def lib():
    out = Tokenizer.from_file(PATH)
    out.no_padding()
    out.no_truncation()
    return out


def expected(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("cache", [1 << 18, 8])
def test_equals_library(spark, lib, monkeypatch, cache):
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()] + [t for i, t in EDGE if i != 12] + EXTRA
    if cache == 8:  # in this process: the workers have caches of their own
        monkeypatch.setattr(bpe, "_CACHE", cache)
        t = bpe.BpeTables(PATH)
        for text in texts[:60] + EXTRA:
            assert np.frombuffer(t.encode(text or ""), "<u4").tolist() == lib.encode(text or "", add_special_tokens=False).ids
        return
    df = spark.createDataFrame([(k, t, 1, "i") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    for r in bpe_encode(df, PATH).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(lib, texts[r.doc_id]) and len(r.ids) == r.n_tokens


def test_one_word_of_300000_letters(spark, lib):
    (r,) = bpe_encode(spark.createDataFrame([(12, "a" * 300_000)], "doc_id long, text string"), PATH).collect()
    assert r.n_tokens == len(r.ids) and sum(r.ids) > 0
    t = bpe.tables(PATH)
    text = bytes(t.decode(np.array(r.ids))).decode().replace(" ", "").replace("</w>", "")
    assert text == "a" * 300_000
    short = lib.encode("a" * 4000, add_special_tokens=False).ids
    assert np.frombuffer(t.encode("a" * 4000), "<u4").tolist() == short


def test_decode_nulls_repeats_and_empty(spark, lib):
    rows = [(None, "one two"), (7, "one two"), (7, "one two"), (8, None)]
    encoded = bpe_encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    got = sorted((str(r.doc_id), r.text) for r in bpe_decode(encoded, PATH).collect())
    both = lib.decode(lib.encode("one two", add_special_tokens=False).ids, skip_special_tokens=False)
    assert got == sorted([("None", both), ("7", both), ("7", both), ("8", "")])
    assert bpe_encode(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_query(spark, lib):
    from loomlog.llm.queries import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op5_bpe"](spark, DIR).collect()}
    assert got == {i: expected(lib, t) for i, t in texts.items()}


def test_equal_words_are_grouped_as_they_come():
    import numpy as np

    from loomlog.llm.bpe_batch import _groups, _words

    points = np.frombuffer("b a b c a b ".encode("utf-32-le"), dtype="<u4")
    firsts, group = _groups(points, *_words(points))
    assert firsts.tolist() == [0, 1, 3] and group.tolist() == [0, 1, 0, 2, 1, 0]
