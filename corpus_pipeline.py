"""A training-corpus pipeline: STAGES over the documents table, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.bpe import bpe_encode
from loomlog.llm.cluster import stored
from loomlog.llm.exact_dedup import exact_dedup
from loomlog.llm.jaccard_join import near_dedup
from loomlog.llm.mixing import mixed_documents
from loomlog.llm.quality import score_quality, train_quality

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good.

    Null and empty texts have the score of the bias alone; a text of any length is scored whole; rows that repeat a
    doc_id or a text are scored each; an empty table stays empty.  Columns beside those of documents go.
    """
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select(_COLUMNS), model).filter("predicted = 1").select(_COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the most code points, then the least doc_id.

    Null and empty texts and those of white space alone are one group; of rows that are equal in all one stays; a null doc_id
    comes last; an empty table stays empty.  Columns beside those of documents go.
    """
    return exact_dedup(docs.select(_COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the least doc_id, null last.

    Rows without words stay, however many; rows that repeat a doc_id are compared by their own texts; texts of any length
    are compared whole; an empty table stays empty.  Columns beside those of documents go.
    """
    return near_dedup(docs.select(_COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole.

    A null source is a source; null and empty texts have no words and come as often as all documents of their source do;
    ties fall to a seeded hash of the row; an empty table stays empty.  Columns beside those of documents go.
    """
    return mixed_documents(docs.select(_COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row.

    Null and empty texts have none; texts of any length are encoded whole; rows that repeat are encoded each; an empty
    table stays empty.  Only doc_id is kept beside the tokens.
    """
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", bpe_stage),
]

#: SQL can express neither the classifier nor the encoder; tests/llm/test_pipeline.py holds the rows of
#: each stage against a plain version, and those of run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("ids"))
