"""The `fixedwidth` data source: headerless files of fixed-width records, little-endian.

Reading: options path, inputs, outputs; encoding (float32), split_bytes, batch_bytes; first and last, the positions to
read. With option pushdown, which `read_corpus` sets where the session
has spark.sql.python.filterPushdown.enabled, conditions on `pos` become such positions too: a record is then one seek. Writing: rows sorted by `pos` in tasks and across them, `write_corpus` sorts them so; each
task writes a piece beside the destination, the commit checks their order and publishes them with their manifest, an
abort leaves nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..errors import PublishFailed, RecordIndexOutOfRange
from ..functions import bf16
from ..shape import RECORDS, Encoding, RecordShape
from . import manifest as manifests
from .discover import corpus_files, discover, record_counts
from .publish import Staging, checked_pieces, in_order_of_position, numbered, record_pieces

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes of records that one task reads, and that one batch holds.
SPLIT, BATCH = 64 << 20, 1 << 20


@dataclass
class Slice(InputPartition):
    """Records first to first + n of a file, whose first record has position `start`."""

    file_ord: int
    path: str
    first: int
    n: int
    start: int


def _shape(options: dict) -> RecordShape:
    return RecordShape(int(options["inputs"]), int(options["outputs"]), Encoding(options.get("encoding", "float32")))


class FixedWidthSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixedwidth"

    def schema(self) -> StructType:
        return RECORDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else FixedWidthReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FixedWidthWriter(self.options, schema, overwrite)


class FixedWidthReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.shape = options["path"], _shape(options)
        self.split, self.batch = int(options.get("split_bytes", SPLIT)), int(options.get("batch_bytes", BATCH))
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None

    def partitions(self) -> list[Slice]:
        files = corpus_files(self.path) if not self.path.endswith(".bin") else discover(self.path)
        per, out, start = max(1, self.split // self.shape.bytes_per_record), [], 0
        for k, (file, n) in enumerate(zip(files, record_counts(files, self.shape), strict=True)):
            low, high = max(0, self.first - start), n if self.last is None else min(n, self.last + 1 - start)
            out += [Slice(k, file.path, i, min(per, high - i), start) for i in range(low, high, per)]
            start += n
        return out or [Slice(0, "", 0, 0, 0)]  # Spark asks for a partition

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        width, wide = self.shape.bytes_per_record, self.shape.values
        per = max(1, self.batch // width)
        if not part.n:
            return
        name = part.path.rsplit("/", 1)[-1]
        with open(part.path, "rb") as f:
            f.seek(part.first * width)
            for i in range(part.first, part.first + part.n, per):
                n = min(per, part.first + part.n - i)
                raw = f.read(n * width)
                flat = np.frombuffer(raw, "<f4") if self.shape.encoding is Encoding.FLOAT32 else bf16.decode(np.frombuffer(raw, "<u2"))
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * wide + 1, wide, dtype=np.int32)), pa.array(flat, pa.float32()))
                index = np.arange(i, i + n, dtype=np.int64)
                columns = [pa.array(np.full(n, part.file_ord, np.int32)), pa.array([name] * n), pa.array(index), pa.array(index + part.start), values]
                yield pa.RecordBatch.from_arrays(columns, names=RECORDS.names)


class PushingReader(FixedWidthReader):
    """A reader that also takes conditions on `pos`; Spark refuses one where the session has the push-down switched off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrow the positions; Spark still applies what bounds them only from outside."""
        for f in filters:
            if getattr(f, "attribute", None) != ("pos",) or f.__class__ not in (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In):
                yield f
                continue
            values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
            if not values:
                self.last = -1  # no position is null, and none is in an empty set
                continue
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.first = max(self.first, min(values) + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                high = max(values) - isinstance(f, LessThan)
                self.last = high if self.last is None else min(self.last, high)
            if isinstance(f, In):
                yield f


@dataclass
class Written(WriterCommitMessage):
    """What a task's attempt wrote."""

    facts: dict


class FixedWidthWriter(DataSourceArrowWriter):
    """Options besides those of the reader: name, of the files; transform, source and metadata, JSON for the manifest."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if "pos" not in schema.names or "values" not in schema.names:
            raise PublishFailed(staging="a frame without pos or values", destination=options["path"])
        self.shape, self.options = _shape(options), dict(options)
        self.columns = [schema.names.index("pos"), schema.names.index("values")]
        self.staging = Staging(options["path"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(next(record_pieces((batch.select(self.columns) for batch in iterator), self.shape, self.staging.path)))

    def commit(self, messages: list[Written | None]) -> None:
        try:
            pieces = checked_pieces([m.facts for m in messages if m is not None], self.shape, self.staging.path)
            output = numbered(pieces, self.staging.path, self.options.get("name", "records.bin"))
            given = [json.loads(self.options.get(k, "{}")) for k in ("transform", "source", "metadata")]
            source = {"record_count": output["record_count"]} | given[1]
            manifests.write(manifests.build({"name": "export", "parameters": {}} | given[0], self.shape, source, output, given[2]), self.staging.path)
            self.staging.publish()
        finally:
            self.staging.discard()

    def abort(self, messages: list[Written | None]) -> None:
        self.staging.discard()


def _options(path: str, shape: RecordShape, more: dict) -> dict[str, str]:
    given = {"path": path, "inputs": shape.inputs, "outputs": shape.outputs, "encoding": shape.encoding.value} | more
    return {k: v if isinstance(v, str) else json.dumps(v) if isinstance(v, dict) else str(v) for k, v in given.items()}


def read_corpus(spark: SparkSession, path: str, shape: RecordShape, **options) -> DataFrame:
    """The records of a corpus directory or file; sizes are checked before any task starts."""
    files = discover(path) if path.endswith(".bin") else corpus_files(path)
    record_counts(files, shape)
    spark.dataSource.register(FixedWidthSource)
    options = {"pushdown": spark.conf.get(PUSHDOWN, "false")} | options
    return spark.read.format("fixedwidth").options(**_options(path, shape, options)).load()


def read_record(spark: SparkSession, path: str, shape: RecordShape, index: int) -> DataFrame:
    """The one record at `index`, by a seek."""
    files = discover(path) if path.endswith(".bin") else corpus_files(path)
    count = sum(record_counts(files, shape))
    if not 0 <= index < count:
        raise RecordIndexOutOfRange(index=index, record_count=count)
    return read_corpus(spark, path, shape, first=index, last=index)


def write_corpus(records: DataFrame, path: str, shape: RecordShape, **options) -> None:
    """Publish a frame of records, in order of position, through the sink."""
    records.sparkSession.dataSource.register(FixedWidthSource)
    in_order_of_position(records).write.format("fixedwidth").mode("overwrite").options(**_options(path, shape, options)).save()
