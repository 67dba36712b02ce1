"""Cleaning pipeline over ``documents``: language, near-duplicates, benchmark passages, personal data, tokens.

Each stage works on what its predecessor kept; all but the last return the columns of ``documents``. NULL and
empty texts have no language and go in the first stage. Repeated rows are one group in the second. Extra columns
are carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import decontaminate, language_id, pii, queries, simhash
from tillbook.llm.common import cut

#: A document goes if its language's posterior is below this (or it has no letter).
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; learned from the labelled documents that are not held out."""
    found = language_id.with_language(docs, docs.where(~queries.held_out()).select("text", "lang"))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: 3-word shingles, links at 2 bits or fewer."""
    return simhash.one_of_each(docs, shingle=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents: one word in 20 or more lies in windows of benchmark items."""
    found = decontaminate.contamination(docs, queries.table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select("k").distinct()
    rows = docs.select(decontaminate.doc_key(F.col("doc_id"), F.col("text")).alias("k"), F.struct(*docs.columns).alias("row"))
    return rows.join(gone, "k", "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are generalised; ``n_chars`` follows the new text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text."""
    return queries.token_digests(docs)


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontamination),
          ("pii", personal_data), ("bpe_round", tokens)]
#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
