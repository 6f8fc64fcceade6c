"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, hard_negatives, jaccard_join, language_id, language_model, mixing, neighbours, quality, secrets, sharding, substring_dedup, token_counts
from .common import read


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(substring_dedup.repeated_passages(read(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language_id.fold("doc_id") == 0)
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(read(spark, sf_dir, "documents")))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = language_id.fold("doc_id")
    scored = language_model.score_texts(docs, training=fold != 1, held=fold == 0)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.shard_rows(rows, shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(mixing.mix_rows(read(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = """
WITH rows AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS print FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, print) AS copy FROM rows),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM rows GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][sid % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS fills_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fills_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fills_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
t AS (SELECT source, source_size, sid, least(cap, (SELECT level FROM l WHERE level <= fills_at ORDER BY fills_at, sid LIMIT 1) * weight) AS target FROM l),
q AS (SELECT n.doc_id, n.size, n.print, n.copy, t.source_size, t.sid, t.target, md5('mix|' || coalesce(CAST(n.doc_id AS VARCHAR), '-') || '|' || n.print || '|' || CAST(n.copy AS VARCHAR)) AS dealt
      FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY dealt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q),
e AS (SELECT u.*, served, (upto + source_size * served) / target AS finish FROM u, (VALUES (0), (1)) v(served) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, sid, served, dealt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM e),
k AS (SELECT sid, dealt, sum(greatest(0, least(size, CAST(floor(1.5 * (SELECT sum(source_size) FROM s)) AS BIGINT) - total + size))) AS taken FROM r GROUP BY sid, dealt)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k ON q.sid = k.sid AND q.dealt = k.dealt
"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(read(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.whole_vectors(read(spark, sf_dir, "embeddings"), label=label)
    return hard_negatives.mine_hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


OP11_SQL = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) x WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (pipeline, op1_decontamination, op2_jaccard_join, op3_substring_dedup, op4_language_id, op5_token_counts, op6_language_model, op7_sharding, op8_neighbours, op9_mixing, op10_secret_scan, op11_hard_negatives, op12_quality_rules, op13_token_alignment)}
ORACLE_SQL = {"op9_mixing": OP9_SQL, "op11_hard_negatives": OP11_SQL}
