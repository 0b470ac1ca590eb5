"""Queries of the corpus operators over the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, langid, packing, pii, quality, simhash, suffix_dedup, toxicity, warc
from .common import table

#: For the demonstration queries where the session sets no key of its own.
PII_KEY = b"riverine demonstration key"


def pii_key(spark: SparkSession) -> bytes:
    """The secret of the session's spark.riverine.pii.key; without it the demonstration key, which protects nothing."""
    own = spark.conf.get("spark.riverine.pii.key", None)
    return own.encode() if own else PII_KEY


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs.where(~langid.held_out(docs, "doc_id", 3, 1)), labels)
    scored = toxicity.score_toxicity(docs, model)
    return scored.withColumn("held_out", langid.held_out(scored, "doc_id", 3, 1)).select("doc_id", "held_out", "score", "predicted", "worst_sentence", "worst_p", F.size("offending").alias("n_offending"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_roundtrip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(~langid.held_out(docs, "doc_id", 5, 0)))
    found = langid.identify_languages(docs, model)
    return found.withColumn("held_out", langid.held_out(found, "doc_id", 5, 0)).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_ann, op2_toxicity, op3_quality, op4_suffix, op5_pii, op6_bpe, op7_simhash, op8_warc, op9_langid, op10_packing)}

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op8_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN m.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m.first <> page_id THEN m.first END AS refers_to
        FROM p LEFT JOIN m USING (d)""",
}
