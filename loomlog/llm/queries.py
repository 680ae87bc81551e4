"""The queries op1 to op13 over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.fingerprints import compare_edited, lexicon

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = lexicon(docs)
    return compare_edited(docs, terms)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.cluster import checkpointed, shared_folder
    from loomlog.llm.warc import assemble, read_warc, write_warc

    path = shared_folder(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    captures = assemble(checkpointed(read_warc(spark, path)))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "referred.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "referred.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("referred.page_id").alias("refers_to"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.sharding import kd_shards

    out = kd_shards(_table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.quality import held_out, score_quality, train_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, _table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.pii import pseudonymise

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key="loomlog").select("doc_id", "text", "n_pseudonyms")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomlog.llm.bpe import bpe_encode

    return bpe_encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomlog.llm.packing import pack

    out = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlog.llm.filter_audit import filter_audit

    out = filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_SQL = {
    "op1_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d),
windows AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY array_to_string(ws[i:i+19], ' ')) AS first FROM starts),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
marked AS (SELECT w.doc_id, w.i, word, max(x.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS 19 PRECEDING) IS NOT NULL AS gone FROM words w LEFT JOIN (SELECT * FROM windows WHERE first < (doc_id, i)) x ON w.doc_id = x.doc_id AND w.i = x.i),
left_over AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)""",
    "op9_jaccard_join": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op4_exact_dedup": r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256 FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op11_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3""",
    "op13_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM d),
c AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, copy AS e FROM w),
m AS (SELECT c.doc_id, part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM c LEFT JOIN labels USING (doc_id)),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(l, x)),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.x, q.x, r.x, s.x, t.x] AS xs FROM f p, f q, f r, f s, f t WHERE p.x + q.x + r.x + s.x + t.x = 31 AND len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT filter_order, unnest(range(1, 6)) AS step, xs FROM o),
g AS (SELECT filter_order, step, xs[step] AS own, coalesce(list_sum(xs[1:step - 1]), 0) AS before FROM k),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
u AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & before = 0 AND mask & own = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM n, (SELECT filter_order, step, own, CAST(before AS INT) AS before FROM g) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM u""",
    "op7_warc": """WITH x AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to FROM x""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
