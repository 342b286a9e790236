"""Frames of records: building them, reading parts of them, and giving them new places."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import RecordIndexOutOfRange
from ..shape import RECORDS, RecordShape

#: Hex digits of a sort key that name a slice of a file; places are counted by slice and ranked only within one.
SLICE_DIGITS = 3
#: Values that a batch of probe records has.
PROBED = 1 << 20


def from_table(df: DataFrame, key: str, values: Column, shards: int = 8) -> DataFrame:
    """Records from any table with a dense 0-based key: dealt over `shards` named files by key."""
    key_col = F.col(key).cast("bigint")
    return df.select(
        F.pmod(key_col, F.lit(shards)).cast("int").alias("file_ord"),
        F.format_string("shard-%03d.bin", F.pmod(key_col, F.lit(shards)).cast("int")).alias("file_name"),
        F.floor(key_col / shards).alias("rec_idx"), key_col.alias("pos"), values.cast("array<float>").alias("values"),
    )


def synthetic(spark: SparkSession, shards: int, records: int, shape: RecordShape) -> DataFrame:
    """Records whose value v is float(global record) + float(v)."""
    rows = spark.range(shards * records)
    value = F.transform(F.sequence(F.lit(0), F.lit(shape.values - 1)), lambda v: F.col("id").cast("float") + v.cast("float"))
    return rows.select(
        F.floor(F.col("id") / records).cast("int").alias("file_ord"),
        F.format_string("shard-%03d.bin", F.floor(F.col("id") / records).cast("int")).alias("file_name"),
        F.pmod("id", F.lit(records)).alias("rec_idx"), F.col("id").alias("pos"), value.alias("values"),
    )


def error_probe(places: DataFrame, place: str, shape: RecordShape) -> DataFrame:
    """Records whose values spread over many exponents, to probe rounding with: value v of global record g is
    (0.017 + 0.001 g) * sqrt(1 + v), negative where v is a multiple of three, every step in float32.

    `places` has the dense 0-based g in the column `place`; values are made in the tasks that read them.
    """
    name, wide = "probe.bin", shape.values
    root = np.sqrt(np.float32(1) + np.arange(wide, dtype=np.float32))
    root[::3] *= -1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, per := max(1, PROBED // wide)):
                g = batch.column(0).to_numpy()[i : i + per]
                flat = ((np.float32(0.017) + g.astype(np.float32) * np.float32(1e-3))[:, None] * root).ravel()
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, wide, dtype=np.int32)), pa.array(flat, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(g), np.int32)), pa.array([name] * len(g)), pa.array(g), pa.array(g), values], names=RECORDS.names)

    return places.select(F.col(place).cast("bigint")).mapInArrow(batches, RECORDS)


def read_record(records: DataFrame, index: int, record_count: int) -> DataFrame:
    if not 0 <= index < record_count:
        raise RecordIndexOutOfRange(index=index, record_count=record_count)
    return records.where(F.col("pos") == index)


#: Arrow types by Spark's names, for schemas that tasks need as well.
ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of "name type, name type"."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def map_values(records: DataFrame, change: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Records with their values changed, batch by batch, by change(values, pos); both are arrays over records.

    Values lie end to end in an Arrow batch, so a change is a few vector operations on them. Built-in array
    functions would call a lambda per value instead. Nothing is shuffled; a null array stays null.
    """
    at, place = records.columns.index("values"), records.columns.index("pos")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column = batch.column(at)
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            pos = batch.column(place).to_numpy(zero_copy_only=False)
            if len(lengths) and (lengths == lengths[0]).all() and lengths[0] * len(lengths) == len(flat):
                new = change(flat.reshape(len(lengths), -1), pos).ravel()
            else:
                new, done = np.empty(len(flat), np.float32), 0
                for n, p in zip(lengths, pos, strict=True):
                    new[done : done + n] = change(flat[None, done : done + n], np.array([p]))[0]
                    done += n
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            mask = column.is_null() if column.null_count else None
            arrays = list(batch.columns)
            arrays[at] = pa.ListArray.from_arrays(offsets, pa.array(new, pa.float32()), mask=mask)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return records.mapInArrow(batches, records.schema)


def replaced(records: DataFrame, file_key: Column, record_key: Column) -> DataFrame:
    """Records with new 0-based positions: files by `file_key`, a file's records by `record_key` (hex digits).

    Positions come from counts of slices of each file, a small table, and ranks within a slice, so no task sorts
    more than a slice, and the result follows from the keys alone.
    """
    fk, rk, cut, n, start = (free_name(records, c) for c in ("file_key", "record_key", "slice", "n", "start"))
    keyed = records.withColumn(fk, file_key).withColumn(rk, record_key)
    keyed = keyed.withColumn(cut, F.conv(F.substring(rk, 1, SLICE_DIGITS), 16, 10).cast("int"))
    slices = keyed.groupBy("file_ord", cut).agg(F.count(F.lit(1)).alias(n), F.min(fk).alias(fk))
    in_file = Window.partitionBy("file_ord").orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    files = slices.groupBy("file_ord").agg(F.sum(n).alias("records"), F.min(fk).alias(fk))
    before = Window.orderBy(fk, "file_ord").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("file_ord", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("files_before"))
    starts = slices.withColumn("records_before", F.coalesce(F.sum(n).over(in_file), F.lit(0))).join(files, "file_ord")
    starts = starts.select("file_ord", cut, (F.col("records_before") + F.col("files_before")).alias(start))
    rank = F.row_number().over(Window.partitionBy("file_ord", cut).orderBy(rk, "rec_idx")) - 1
    placed = keyed.join(starts, ["file_ord", cut]).withColumn("pos", (F.col(start) + rank).cast("bigint"))
    return placed.select(*records.columns)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it as long as a column of `df` is called so, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def one_file(records: DataFrame, name: str) -> DataFrame:
    """The records as a derived corpus holds them: one file, in order of position."""
    return records.withColumns({"file_ord": F.lit(0), "file_name": F.lit(name), "rec_idx": F.col("pos")}).select(*records.columns)
