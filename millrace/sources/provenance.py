"""Manifests as a table: every published corpus under a root with what made it, and the chain a corpus came by."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest as manifests

#: The parts of a manifest that are columns; parameters differ by transform, so they stay variants.
SCHEMA = (
    "manifest_version int, created_at_unix bigint, transform struct<name string, parameters variant, seed decimal(20,0)>, "
    "pipeline array<struct<name string, parameters variant, seed decimal(20,0)>>, record_shape struct<inputs bigint, outputs bigint, encoding string>, "
    "source struct<path string, record_count bigint>, output struct<record_count bigint, bytes bigint>, metadata map<string, string>"
)


def corpora(spark: SparkSession, root: str) -> DataFrame:
    """(path, created_at_unix, transform, parameters, seed, stages, encoding, source_path, records_read,
    records_written, bytes, metadata) of every corpus at any depth under `root`; those of unknown versions are left out."""
    found = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", manifests.FILE).json(root)
    path = F.url_decode(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/"), r"\+", "%2B"))
    rows = found.where(F.col("manifest_version") == manifests.VERSION)
    return rows.select(
        F.regexp_replace(path, f"/{manifests.FILE}$", "").alias("path"), "created_at_unix", F.col("transform.name").alias("transform"), F.col("transform.parameters").alias("parameters"),
        F.col("transform.seed").alias("seed"), F.size(F.coalesce("pipeline", F.array())).cast("bigint").alias("stages"), F.col("record_shape.encoding").alias("encoding"), F.col("source.path").alias("source_path"),
        F.col("source.record_count").alias("records_read"), F.col("output.record_count").alias("records_written"), F.col("output.bytes").alias("bytes"), "metadata",
    )


def lineage(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The corpora that `path` was made from, back to the first one with a manifest under `root`; `step` is 0 for
    `path` itself. A corpus made anew in a place that it came from ends the chain at the number of corpora."""
    table = corpora(spark, root).drop("parameters", "metadata")
    return spark.sql(
        """
        WITH RECURSIVE known AS (SELECT * FROM {table}),
        chain AS (
          SELECT 0L AS step, known.* FROM known WHERE path = {path}
          UNION ALL
          SELECT chain.step + 1 AS step, known.* FROM chain JOIN known ON known.path = chain.source_path WHERE chain.step < (SELECT count(*) FROM known))
        SELECT * FROM chain""",
        table=table, path=os.path.realpath(path),
    )
