"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in
the shared folder and read again as the next stage's docs.  All stages but the
last return the columns of documents, and any further ones, whatever their
names, as they were.

Cases: null and empty texts have no language and leave at the first stage;
rows are told apart by all their columns, so rows that share a doc_id (null
too) but have other texts are documents of their own, and of rows that are
equal in all columns one stays, as of any group of near copies; very long texts
are read whole; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from riverine.llm import langid, packing, pii, simhash, suffix_dedup
from riverine.llm.common import table, written
from riverine.llm.queries import pii_key


def _name(column: str) -> str:
    """A column's name as Spark reads it, dots and all."""
    return "`" + column.replace("`", "``") + "`"


def _other(docs: DataFrame) -> DataFrame:
    """(row, text): all columns but text as one struct, which an operator takes as its id and hands through."""
    return docs.select(F.struct(*[F.col(_name(c)) for c in docs.columns if c != "text"]).alias("row"), "text")


def _whole(docs: DataFrame, done: DataFrame) -> DataFrame:
    """The columns of docs again, text from done, n_chars by it."""
    size = {c: F.length("text").cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return done.select(*[F.col("text") if c == "text" else size.get(c, F.col(f"doc_id.{_name(c)}")).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected (no letters, or unlike every learned language)."""
    model = langid.fit_languages(docs.where(~langid.held_out(docs, "doc_id", 5, 0)))
    found = langid.identify_languages(_other(docs), model, id_col="row", keep_text=True)
    return _whole(docs, found.where(~F.col("rejected")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest doc_id.

    A document's key is its doc_id (null last) and a hash of all its columns,
    which parts rows that share an id; only keys are joined with the texts.
    """
    text = [F.col(_name(c)) for c in docs.columns]
    key = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", F.xxhash64(*text).alias("h1"), F.xxhash64(F.lit("second"), *text).alias("h2"))
    keyed = docs.select(key.alias("key"), F.struct(*text).alias("row"))
    kept = simhash.near_duplicates(keyed.select("key", "row.text"), id_col="key").where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte of strings of 200 bytes that occur elsewhere too."""
    return _whole(docs, suffix_dedup.remove_repeats(_other(docs), id_col="row", with_text=True))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return _whole(docs, pii.pseudonymise(_other(docs), pii_key(spark), id_col="row"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_copies", near_copies), ("repeats", repeats), ("privacy", privacy), ("packing", packed)]

#: Learned models and hashes of tokens aren't SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
