"""The corpus pipeline: quality rules, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; ``run``
writes each stage's result and reads it again for the next. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import langid, neardup, quality, secrets
from tallyhouse.llm.common import crc_mod, prepare, small, stored
from tallyhouse.llm.queries import pack_documents
from tallyhouse.sources.tables import table

#: Share of a text's n-grams that must belong to the chosen language.
LEAST_LANGUAGE = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject; a null text has no words and goes.

    Equal texts share a verdict; columns of any name come through as they are.
    """
    rules = quality.learn_rules(quality.labelled_sample(docs, table(spark, sf_dir, "labels")))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))
    return quality.apply_rules(quality.text_statistics(rows, "_text"), rules).where("kept").select("_doc.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a text that is null or without a letter goes. Any other column comes through."""
    prepare(spark)
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), "text")
    found = langid.identify_languages(rows, langid.learn_languages(docs.where(~held)))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE)).select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the least doc_id. Rows without text or id stay."""
    prepare(spark)
    return neardup.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret is replaced by a mask, and n_chars follows. A null text stays null."""
    found = secrets.scan_ledger(docs.select("doc_id", "text"))
    hit = stored(found.where(F.size("spans") > 0).select(F.col("blob").alias("_secret_blob"), F.lit(True).alias("_hit")).distinct())
    rows = docs.withColumn("_secret_blob", secrets.blob_of(F.col("text"))).join(small(hit), "_secret_blob", "left")
    rows = secrets.redacted(rows, where=F.coalesce(F.col("_hit"), F.lit(False)))
    size = F.when(F.col("_hit"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", size).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    prepare(spark)
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
