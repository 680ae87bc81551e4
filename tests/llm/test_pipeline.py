"""Each stage of the pipeline, and run(), against plain versions on whole tables."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_bpe import expected, lib  # noqa: F401
from test_llm import EDGE
from test_mixing import brute_mix, n_words
from test_near_dedup import brute_near_dedup

import corpus_pipeline
from loomlog.llm.mixing import row_hash
from loomlog.llm.quality import train_quality
from loomlog.llm.textops import slices

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(10_000 + i if i is not None else None, t, "en", None if i in (4, 9) else f"s{(i or 0) % 2}", len(t or "")) for i, t in EDGE]
    return spark.read.parquet(f"{DIR}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).unionByName(spark.createDataFrame(extra, SCHEMA))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_quality_stage(spark, docs):
    model = train_quality(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    every = rows(docs)
    scores = np.concatenate([model.scores(d, o) for _, _, d, o in slices(pa.array([r[1] or "" for r in every]))])
    want = Counter(r for r, s in zip(every, scores) if s >= 0.3)
    out = STAGES["quality classifier"](spark, docs, DIR)
    assert out.columns == docs.columns and Counter(rows(out)) == want


def test_exact_stage(spark, docs):
    groups = {}
    for r in rows(docs):
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        best = lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0)
        groups[key] = min(groups.get(key, r), r, key=best)
    out = STAGES["exact dedup"](spark, docs, DIR)
    pick = lambda r: (r[0], len(r[1] or ""))
    assert out.columns == docs.columns and Counter(map(pick, rows(out))) == Counter(map(pick, groups.values()))


def test_near_stage(spark, docs):
    want = brute_near_dedup([(r[0], r[1]) for r in rows(docs)])
    out = STAGES["n-gram Jaccard join"](spark, docs, DIR)
    left = Counter((r[0], r[1]) for r in rows(out))
    assert out.columns == docs.columns and sum(left.values()) == len(want)
    for choice in want:
        hit = next(x for x in choice if left[x] > 0)
        left[hit] -= 1


def test_mixing_stage(spark, docs):
    hashed = [((r.doc_id, r.source, n_words(r.text)), r.source, n_words(r.text), r.h) for r in docs.withColumn("h", row_hash(17)).collect()]
    _, mix = brute_mix(hashed, True)
    want = Counter()
    for (key, _, repeats, _), n in mix.items():
        want[key] += repeats * n
    out = STAGES["mixing sources"](spark, docs, DIR)
    got = Counter((r[0], r[3], n_words(r[1])) for r in rows(out))
    some = lambda c: {k: v for k, v in c.items() if k[2] and v}
    assert out.columns == docs.columns and some(got) == some(want)


def test_bpe_stage(spark, lib, docs):  # noqa: F811
    texts = Counter((r[0], *expected(lib, r[1])) for r in rows(docs.filter("doc_id IS NULL OR doc_id <> 10012")))
    out = STAGES["BPE encoding"](spark, docs.filter("doc_id IS NULL OR doc_id <> 10012"), DIR)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == texts


def test_run_is_its_stages(spark, lib):  # noqa: F811
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    step = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.stored(stage(spark, step, DIR), "test")
    want = Counter((r.doc_id, *expected(lib, r.text)) for r in step.collect())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DIR).collect())
    assert got == want and 0 < len(want) < table.count()


def test_stages_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DIR).count() == 0


def test_stages_keep_to_their_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11, 5, "x", 0.5)], SCHEMA + ", size int, row string, score double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, DIR)
        assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")] and out.filter(F.col("doc_id") == 1).count() <= 3
