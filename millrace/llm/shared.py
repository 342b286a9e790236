"""What the operators share: the folder for intermediate tables, row locators, and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that go to one task, and the most keys that can be hot.
ROWS_PER_COPY, HOT_KEYS = 1_000, 10_000
#: Rows of a file of a table of numbers whose length is known.
ROWS_PER_FILE = 10_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; where that is unset, a local folder, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext.getCheckpointDir()
        if kept is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
            kept = spark.sparkContext.getCheckpointDir()
        root = kept
    return f"{root.rstrip('/')}/millrace/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later jobs start from the files, not the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # the table stands, so its shuffles can go
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, most: int) -> DataFrame:
    """df, which is about to be written and has `most` rows of numbers at most, in partitions of up to ROWS_PER_FILE of
    them, but one for every core: as many files as a shuffle has partitions cost a task a file in each later job."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, most // ROWS_PER_FILE))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it as long as a column of `df` is called so, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number per row, as a written table, so that a row keeps its number in every later job; and the
    name of the number's column, which docs does not have. Stages decide by it, as identifiers may be missing or repeat."""
    row = free_name(docs, "row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def in_order(df: DataFrame, deal: list, order: list, name: str) -> tuple[DataFrame, str]:
    """df as a written table with a number per row that grows with `order`, and the number's column, which df lacks.

    Rows are dealt by ranges of `deal`, which `order` refines, so a key that most rows share is spread all the same,
    and no window holds it.
    """
    at = free_name(df, "at")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *deal).sortWithinPartitions(*order)
    return written(dealt.withColumn(at, F.monotonically_increasing_id()), name), at


def hot_keys(counts: DataFrame, key: list[str], total: int) -> DataFrame | None:
    """(key, copies) from (key, n), for broadcasting: the keys with more rows than ROWS_PER_COPY and than one in
    HOT_KEYS of all `total` rows, of which there can be no more than HOT_KEYS; None if there are none."""
    limit = max(ROWS_PER_COPY, total // HOT_KEYS)
    if total <= limit:
        return None
    hot = counts.where(F.col("n") > limit).select(*key, F.ceil(F.col("n") / limit).cast("int").alias("copies"))
    found = hot.collect()  # HOT_KEYS at most
    return F.broadcast(counts.sparkSession.createDataFrame(found, hot.schema)) if found else None


def spread_join(many: DataFrame, one: DataFrame, key: str | list[str], by: str, hot: DataFrame | None | str = "") -> DataFrame:
    """Inner join of `many`, in which one key may have a third of the rows, with `one`, which has few rows a key.

    The rows of a hot key in `many` are dealt by a hash of the column `by` over as many copies of its rows in `one`.
    `many` has to be a written table where `hot` is not given. Keys are not null; no other column is in both.
    """
    key = [key] if isinstance(key, str) else key
    if isinstance(hot, str):
        hot = hot_keys(many.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key, many.count())
    if hot is None:
        return many.join(one, key)
    dealt = many.join(hot, key, "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64(by), F.col("copies")), F.lit(0)).cast("int")).drop("copies")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy")
    copied = one.join(hot, key, "left").select(*one.columns, each)
    return dealt.join(copied, [*key, "copy"]).drop("copy")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
