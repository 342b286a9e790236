"""Exact deduplication as a stateful stream over digests, with full bytes checked on every hit.

Arrivals (digest, stable identifier, content locator) stream through an aggregation whose keyed state lies on
disk and never expires: for each digest it retains the smallest identifier, its locator and the number of rows.
The locator is the number of the row in a table that was written first, so it finds one text whatever identifiers
repeat or are missing. A digest only nominates: every row that hits retained content is compared with it byte for
byte, and rows whose bytes differ although their digests agree are grouped again by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hot_keys, numbered, shared_dir, spread_join, written

SPACES = r"[\x20\x09-\x0D]+"
#: Micro-batches that the arrivals of one call come in, as far as they are files enough: all but the first find
#: retained state. A stream that goes on, as in `run_stream`, has as many as there are new files for.
MICRO_BATCHES = 4


def normalised(text: Column) -> Column:
    """Text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def retained(arrivals: DataFrame) -> DataFrame:
    """The keyed state: digest -> smallest (identifier, locator) and rows so far.

    `arrivals` is a streaming or a batch frame with `digest` and `at` (a struct ordered by identifier).
    """
    return arrivals.groupBy("digest").agg(F.min("at").alias("keep"), F.count(F.lit(1)).alias("n"))


def run_stream(arrivals: DataFrame, path: str) -> DataFrame:
    """Run the table `arrivals` (Parquet under `path`/arrivals) through the stateful stream; return its final state.

    State is RocksDB, with its checkpoint in the shared folder, so a lost executor reloads it and a later run with
    new files continues it. Each micro-batch appends the digests that changed; the newest row of a digest holds.
    """
    spark = arrivals.sparkSession
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        files = max(1, -(-len(arrivals.inputFiles()) // MICRO_BATCHES))
        stream = retained(spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/arrivals"))

        def append(changed: DataFrame, batch: int) -> None:
            changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/state/batch={batch}")

        query = (
            stream.writeStream.outputMode("update").foreachBatch(append)
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changed = stream.select("digest", "keep", "n").schema.add("batch", "long")
    newest = spark.read.schema(changed).parquet(f"{path}/state")
    return newest.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s")).select("digest", "s.keep", "s.n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, row_col: str | None = None, state_dir: str | None = None) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when their normalised bytes are. Null text counts as empty, and empty texts equal each other.
    Of equal texts the smallest id stays, nulls last; of repeated rows with that id exactly one has kept = true.
    An empty table gives no rows. Other columns of `docs` are not read, so their names cannot clash. `row_col` names
    a column that is unique and stable (shared.numbered); it then comes out too and tells which row is meant.
    `state_dir` names a new folder for arrivals, state and checkpoint, which `run_stream` can go on with; without it
    they go to the shared folder. Texts of any length count whole.
    """
    if row_col is None:
        docs, row = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    else:
        docs, row = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), row_col), row_col
    path = state_dir or shared_dir(docs.sparkSession)
    rows = docs.select("id", normalised(F.col("text")).alias("norm"), F.col(row).alias("row"))
    at = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    arrivals = rows.select(digest(F.col("norm")).alias("digest"), sha256_digest(F.col("norm")).alias("sha"), at.alias("at"))
    arrivals.write.option("compression", "zstd").parquet(f"{path}/arrivals")
    arrivals = docs.sparkSession.read.schema(arrivals.schema).parquet(f"{path}/arrivals")
    state = written(run_stream(arrivals, path), "state")
    hot = hot_keys(state, ["digest"], arrivals.count())
    hits = spread_join(arrivals.drop("sha"), state.where("n > 1").drop("n"), "digest", "at.row", hot)
    texts = written(rows.select("row", "norm").join(hits.withColumn("row", F.col("at.row")), "row").select("digest", "at", "keep", "norm"), "texts")
    differing = _differing(texts, hot)
    regroup = _by_text(texts, differing)
    settled = state.join(differing.withColumn("differs", F.lit(True)), "digest", "left").where("differs IS NULL").drop("differs")
    plain = spread_join(arrivals, settled, "digest", "at.row", hot).select("at", "keep", "n", "sha")
    return plain.unionByName(regroup).select(
        F.col("at.id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("at") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
        *([F.col("at.row").alias(row_col)] if row_col else []),
    )


def _differing(texts: DataFrame, hot: DataFrame) -> DataFrame:
    """Digests under which some row's bytes differ from the retained row's; a hot digest is spread over copies."""
    kept = texts.where("at = keep").select("digest", F.col("norm").alias("kept_norm"))
    rows = spread_join(texts.where("at != keep"), kept, "digest", "at.row", hot)
    return written(rows.where("norm != kept_norm").select("digest").distinct(), "differing")


def _by_text(texts: DataFrame, differing: DataFrame) -> DataFrame:
    """Rows of colliding digests, grouped by the text itself."""
    again = texts.join(differing, "digest", "left_semi").select("digest", "at", "norm").withColumn("sha", sha256_digest(F.col("norm")))
    groups = again.groupBy("digest", "norm").agg(F.min("at").alias("keep"), F.count(F.lit(1)).alias("n"))
    return again.join(groups, ["digest", "norm"]).select("at", "keep", "n", "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all its columns kept.

    Rows are decided one by one, so identifiers may repeat; a row without one stays only if no equal text has one.
    """
    rows, row = numbered(docs)
    kept = exact_groups(rows, id_col, text_col, row_col=row).where("kept").select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)
