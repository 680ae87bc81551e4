"""Packing against plain best-fit decreasing and the tokenizers library, and its edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from loomlog.llm import bpe_batch, packing
from loomlog.llm.bpe import BpeTables
from loomlog.llm.packing import Capacities, Plan, best_fit, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, part int, size int, ids string, `offset` long"


def plain_best_fit(counts, window):
    """Item after item, from the longest: into the window with the least room that holds it; how full the windows get.

    Of windows with equal room any may be taken: how full they get does not depend on it.
    """
    windows = []
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [w for w in windows if window - sum(w) >= size]
        if fits:
            min(fits, key=lambda w: window - sum(w)).append(size)
        else:
            windows.append([size])
    return Counter(map(sum, windows))


@pytest.mark.parametrize("seed", range(30))
def test_windows_are_those_of_item_after_item(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 16, 50])
    counts = {rng.randint(1, window - 1): rng.choice([1, 2, 3, 17, 40]) for _ in range(rng.randint(0, 12))}
    got, items_got = Counter(), Counter()
    for n, items in best_fit(counts, window):
        got[sum(s * k for s, k in items)] += n
        for s, k in items:
            items_got[s] += n * k
    assert got == plain_best_fit(counts, window) and items_got == Counter(counts)


def test_tightest_capacity():
    rng, tree, have = random.Random(1), Capacities(2048), Counter()
    for _ in range(3000):
        c = rng.randint(0, 2048)
        n = -1 if have[c] and rng.random() < 0.6 else 1
        tree.add(c, n)
        have[c] += n
        least = rng.randint(0, 2048)
        assert tree.tightest(least) == min((k for k, v in have.items() if v and k >= least), default=-1)


def test_plan_is_small_whatever_the_number_of_items():
    rng = random.Random(2)
    counts = {s: rng.randint(0, 10**9) for s in range(1, 2048)}
    plan = Plan(counts)
    assert len(plan.rows) < 100_000 and len(plan.gaps) < 10_000
    assert plan.sequences - sum(s * n for s, n in counts.items()) // 2048 <= 11


def check(rows, docs, window):
    """Every id in one piece, sequences whole and without padding; rows: those of pack()."""
    tok = tokenizers.Tokenizer.from_file(PATH)
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in docs)
    by_sequence = defaultdict(list)
    for r in rows:
        assert 0 < r.length and len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    total = sum(len(ids) for _, ids in want)
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items()) and total
    # Rows that repeat a doc_id are told apart by their text: what each piece holds is looked up in its document.
    found = Counter()
    for r in rows:
        found[r.doc_id, r.doc_tokens, r.start, r.length, bytes(r.ids)] += 1
    for (i, ids), n in want.items():
        raw, at = np.array(ids, dtype="<u4").tobytes(), 0
        for _ in range(n):
            at = 0
            while at < len(ids):
                key = next(k for k in found if found[k] and k[0] == i and k[1] == len(ids) and k[2] == at and k[4] == raw[4 * at : 4 * (at + k[3])])
                found[key] -= 1
                at += key[3]
    assert not +found


@pytest.mark.parametrize("window, seed", [(2048, 1), (64, 2), (16, 3)])
def test_every_id_in_one_piece(spark, window, seed):
    rng = random.Random(seed)
    words = ["the", "anblewh", "it's", "12", "é", "日本", "!!", "x"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for k in range(120)]
    docs += [(200, None), (201, ""), (None, "no id"), (None, "no id"), (5, "again"), (5, "again"), (202, "q " * 9000), (203, "<|endoftext|> b")]
    docs += [(300 + k, "same words here") for k in range(90)]  # a size that nothing complements
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in docs], SCHEMA).repartition(7)
    rows = pack(df, PATH, window=window).collect()
    check(rows, docs, window)


def test_one_size_only_is_cut_to_fill(spark):
    docs = [(k, "a " * 39) for k in range(50)]  # 40 ids each; three fit a window of 128
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, window=128).collect()
    check(rows, docs, 128)
    assert len({r.sequence_id for r in rows}) <= 50 * 40 // 128 + 7


def test_offsets_by_a_join_are_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3, "doc_id").cache()
    a = sorted(tuple(r) for r in pack(docs, PATH).collect())
    monkeypatch.setattr(packing, "_MOST_BROADCAST", 0)
    assert a == sorted(tuple(r) for r in pack(docs, PATH).collect())
    check(pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_query(spark):
    from loomlog.llm import queries

    d = "/root/testdata/sf0.001"
    tok = tokenizers.Tokenizer.from_file(PATH)
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.queries()["op12_packing"](spark, d).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())


def test_batches_equal_the_encoder_by_words(monkeypatch):
    t = BpeTables(PATH)
    odd = ["it's he'll 'tis ''s !!'re a's'd x'sfoo 'lla 'l 'r 've'", "İstanbul ΣΑΣ é 12½٣4", "", " ", None, "<|endoftext|> a<|startoftext|>b'", "'", "'s", "a" * 5000, "日本語 テスト　x\x1cy\x85z", "n" * 3000 + " 's " + "q " * 2000, "'\n's", "1'd 2'2"]
    want = [t.encode(x or "") for x in odd]
    for batch in (1, 50, 1 << 19):
        monkeypatch.setattr(bpe_batch, "_BATCH", batch)
        got = [(lo, hi, [y.tobytes() for y in p]) for lo, hi, p in bpe_batch.encode_texts(t, pa.array(odd))]
        assert [y for _, _, p in got for y in p] == want and [lo for lo, _, _ in got] == [0, *(hi for _, hi, _ in got[:-1])]
    monkeypatch.setattr(bpe_batch, "mix", lambda h: h % np.uint64(5))  # words that collide
    assert [y.tobytes() for _, _, p in bpe_batch.encode_texts(t, pa.array(odd)) for y in p] == want
