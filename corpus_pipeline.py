"""From raw documents to a training mix: five stages, each one operator, each over all that the one before kept.

Every stage decides rows, not ids: ids may repeat or be missing. Null and blank texts are rejected by the first stage;
null languages and sources are languages and sources of their own in the mix; of rows with equal or linked texts the
least id stays, nulls last, and of rows tied in id one; texts of any length are read whole; other columns pass through,
whatever they are called, up to the last stage; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from millrace.llm.shared import table, written
from millrace.llm.targets import EPOCHS, SEED, WEIGHTS, domain, total_tokens, words


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer accepts."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.near_dedup(docs, size=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document: doc_id, domain, lang, source, tokens, epoch, budget."""
    out = mixing.mix(docs, WEIGHTS, total_tokens(), words(F.col("text")), domain(F.col("source")), SEED, EPOCHS)
    return out.select("doc_id", "domain", "lang", "source", "tokens", F.col("epoch").cast("bigint").alias("epoch"), "budget")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: The first stage's model has no form in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
