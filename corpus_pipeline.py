"""The corpus pipeline: quality, toxicity, near duplicates, secrets, packing.

Each stage works on all that its predecessor kept, and its decisions take effect; all
but the last return the columns of documents. Near duplicates are texts whose sets of
five-word shingles have a similarity of 0.8 or more.

In every stage a null text counts as empty, an empty table gives an empty table, and other
columns, whatever their names, are kept as they are (but for the last stage, which has its
own). Rows are told apart by id and text; a row that repeats both is one document for the
near-duplicate stage and a document of its own for the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm import jaccard, packing, quality, secretscan, toxicity
from mailloom.llm.common import load, stored
from mailloom.operators.dedup import first_of_each

SHINGLE, PERCENT = 5, 80
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects; null and empty texts fail the base. Rows with null or repeated ids are judged by their texts like all others."""
    return quality.keep_good(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts score as texts without any offending token. Without labels of both classes every document scores the share of toxic labels."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, null ids last, ties by a hash of the text.

    Of rows that repeat the id and the text of the one that stays, one stays, the first by a hash of all columns. Texts without
    words are near duplicates of nothing: of these only repeated rows go.
    """
    row = {"__mailloom_id": F.coalesce("doc_id", F.lit(0)), "__mailloom_none": F.col("doc_id").isNull(), "__mailloom_th": jaccard.text_hash()}
    keep = jaccard.representatives(docs, PERCENT, SHINGLE).select(F.coalesce("doc_id", F.lit(0)).alias("__mailloom_id"), F.col("doc_id").isNull().alias("__mailloom_none"), F.col("th").alias("__mailloom_th"))
    rows = docs.withColumns(row).join(keep, list(row), "left_semi").withColumn("__mailloom_all", F.xxhash64(*docs.columns))
    return first_of_each(rows, list(row), ["__mailloom_all"]).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret, and n_chars of the text as it is then; a null text stays null, and so does its n_chars."""
    out = secretscan.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences; a null or empty text is one piece, the end token, and repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("jaccard", jaccard_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None
"""Learned models and token ids are beyond SQL; tests compare with plain Python instead."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
