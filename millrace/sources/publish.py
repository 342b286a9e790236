"""Publishing a corpus: written whole beside its destination, then renamed into place, a manifest always with it.

Executors write the records as ordered pieces, a task's rows to its own file, so nothing passes through the driver.
A corpus is the files of a directory in name order, and as such pieces are complete; where one named file is asked
for they are put end to end, in blocks. The destination is a folder that driver and executors share.
"""

from __future__ import annotations

import hashlib
import os
import secrets
import shutil
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptySource, InvariantBroken, PublishFailed, RecordLengthMismatch
from ..functions import bf16
from ..shape import Encoding, RecordShape
from . import manifest as manifests

BLOCK = 1 << 22


class Staging:
    """A scratch directory beside `destination` that becomes it, or goes."""

    def __init__(self, destination: str):
        self.destination = destination
        parent, name = os.path.split(os.path.abspath(destination))
        mark = f"{time.time_ns()}-{os.getpid()}"
        self.path, self.aside = os.path.join(parent, f".{name}.staging-{mark}"), os.path.join(parent, f".{name}.deleting-{mark}")
        os.mkdir(self.path)

    def publish(self) -> None:
        moved = os.path.lexists(self.destination)
        try:
            if moved:
                os.rename(self.destination, self.aside)
            os.rename(self.path, self.destination)
        except OSError as e:
            if moved and not os.path.lexists(self.destination) and os.path.lexists(self.aside):
                os.rename(self.aside, self.destination)
            raise PublishFailed(staging=self.path, destination=self.destination) from e

    def discard(self) -> None:
        for path in (self.path, self.aside):
            if os.path.lexists(path):
                shutil.rmtree(path, ignore_errors=True)


@contextmanager
def staged(destination: str) -> Iterator[str]:
    """A scratch directory beside `destination` that becomes it at the end; on any error nothing changes."""
    staging = Staging(destination)
    try:
        yield staging.path
        staging.publish()
    finally:
        staging.discard()


def encoded(values: np.ndarray, encoding: Encoding) -> np.ndarray:
    """The values as they lie on disk, one after the other."""
    return np.ascontiguousarray(values, "<f4") if encoding is Encoding.FLOAT32 else bf16.encode(values).astype("<u2", copy=False)


class Piece:
    """One task's file of a corpus, under a name of its own attempt, so that only the attempt that reports counts."""

    def __init__(self, directory: str, shape: RecordShape):
        self.shape, self.name = shape, f"piece-{secrets.token_hex(8)}"
        self.path = os.path.join(directory, self.name)
        self.file, self.digest, self.records, self.bytes = open(self.path, "wb", buffering=0), hashlib.sha256(), 0, 0

    def write(self, values: np.ndarray) -> None:
        """Records end to end."""
        raw = memoryview(encoded(values, self.shape.encoding)).cast("B")
        self.digest.update(raw)
        while raw:
            done = self.file.write(raw)
            self.bytes, raw = self.bytes + done, raw[done:]
        self.records += values.size // self.shape.values

    def close(self, keep: bool) -> None:
        """Have the file on disk, or gone where it is not to be kept or holds nothing."""
        keep = keep and self.records > 0
        if keep:
            os.fsync(self.file.fileno())
        self.file.close()
        if not keep:
            os.unlink(self.path)
            self.records, self.name = 0, None

    def facts(self) -> dict:
        return {"name": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.digest.hexdigest() if self.records else None}


PIECES = "part int, low bigint, high bigint, name string, records bigint, bytes bigint, sha256 string, actual int, ordered boolean"


def record_pieces(it: Iterator[pa.RecordBatch], shape: RecordShape, directory: str) -> Iterator[dict]:
    """A task's rows (pos, values), in order, as one piece; what it tells, or the length of a record that is not one."""
    piece, low, high, actual, ordered = Piece(directory, shape), None, None, None, True
    for batch in it:
        pos, column = batch.column(0).to_numpy(), batch.column(1)
        if not len(pos):
            continue
        lengths = np.diff(column.offsets.to_numpy())
        if wrong := lengths[lengths != shape.values].tolist():
            actual = int(wrong[0])
            break
        ordered &= bool((np.diff(pos) > 0).all() and (high is None or pos[0] > high))
        low, high = int(pos[0]) if low is None else low, int(pos[-1])
        piece.write(column.flatten().to_numpy(zero_copy_only=False))
    piece.close(keep=actual is None)
    yield {"part": TaskContext.get().partitionId(), "low": low, "high": high, **piece.facts(), "actual": actual, "ordered": ordered}


def in_order_of_position(records: DataFrame) -> DataFrame:
    return records.select("pos", "values").repartitionByRange("pos").sortWithinPartitions("pos")


def write_pieces(records: DataFrame, shape: RecordShape, directory: str) -> list[dict]:
    """Write records in order of position as files of `directory`; (name, records, bytes, sha256) of each, in order."""
    from ..operators.records import arrow_schema

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist(list(record_pieces(it, shape, directory)), arrow_schema(PIECES))

    told = [r.asDict() for r in in_order_of_position(records).mapInArrow(write, PIECES).collect()]
    return checked_pieces(told, shape, directory)


def checked_pieces(told: list[dict], shape: RecordShape, directory: str) -> list[dict]:
    """The pieces that tasks told of, in order of their records; files of attempts that did not report go."""
    for t in told:
        if t["actual"] is not None:
            raise RecordLengthMismatch(path=directory, expected=shape.values, actual=t["actual"])
        if not t["ordered"]:
            raise InvariantBroken(check="record order", detail=f"positions of task {t['part']} do not grow")
    found = sorted((t for t in told if t["records"]), key=lambda t: t["low"])
    for one, other in zip(found, found[1:], strict=False):
        if one["high"] >= other["low"]:
            raise InvariantBroken(check="record order", detail=f"positions {one['low']} to {one['high']} and from {other['low']} overlap")
    drop_strays(directory, {t["name"] for t in found})
    return found


def drop_strays(directory: str, wanted: set[str]) -> None:
    for name in os.listdir(directory):
        if name.startswith("piece-") and name not in wanted:
            os.unlink(os.path.join(directory, name))


def numbered(pieces: list[dict], directory: str, file_name: str) -> dict:
    """The pieces under the corpus's name and their numbers, as an entry of its manifest."""
    stem, listed = file_name.removesuffix(".bin"), []
    if not pieces:  # a corpus of no records is an empty file
        pieces = [{"name": "piece-none", "records": 0, "bytes": 0, "sha256": hashlib.sha256().hexdigest()}]
        open(os.path.join(directory, "piece-none"), "wb").close()
    for k, p in enumerate(pieces):
        name = f"{stem}-{k:05d}.bin"
        os.rename(os.path.join(directory, p["name"]), os.path.join(directory, name))
        listed.append(_output(name, p["records"], p["bytes"], p["sha256"]))
    return {"file": listed[0]["file"], "record_count": sum(x["record_count"] for x in listed), "bytes": sum(x["bytes"] for x in listed), "files": listed}


def joined(pieces: list[dict], directory: str, file_name: str) -> dict:
    """The pieces end to end as one file, as an entry of the manifest: a sequential pass over it for its digest."""
    digest, path = hashlib.sha256(), os.path.join(directory, file_name)
    with open(path, "wb") as out:
        for p in pieces:
            own = os.path.join(directory, p["name"])
            with open(own, "rb") as f:
                while raw := f.read(BLOCK):
                    digest.update(raw)
                    out.write(raw)
            os.unlink(own)
        out.flush()
        os.fsync(out.fileno())
    return _output(file_name, sum(p["records"] for p in pieces), os.path.getsize(path), digest.hexdigest())


def _output(file: str, count: int, size: int, digest: str) -> dict:
    return {"file": file, "record_count": count, "bytes": size, "checksum": {"algorithm": "sha256", "value": digest}}


def publish(
    records: DataFrame | None, shape: RecordShape, destination: str, file_name: str, transform: dict, source: dict, metadata: dict,
    source_shape: RecordShape | None = None, stages: list[dict] | None = None, single_file: bool = False, pieces: Callable[[str], list[dict]] | None = None,
) -> dict:
    """Publish records as a corpus and return its manifest: its pieces, numbered, with `output.file` naming the first
    and `output.files` all; with `single_file` one file, `file_name`.

    Records come as a frame in any partitioning, or from `pieces`, which has tasks write them into a directory.
    """
    pieces = pieces or (lambda directory: write_pieces(records, shape, directory))
    with staged(destination) as staging:
        output = (joined if single_file else numbered)(pieces(staging), staging, file_name)
        if output["bytes"] != output["record_count"] * shape.bytes_per_record:
            raise InvariantBroken(check="published bytes", detail=f"{output['bytes']} for {output['record_count']} records")
        made = manifests.build(transform, shape, source, output, metadata, source_shape, stages)
        manifests.write(made, staging)
    return made


def write_synthetic(spark, directory: str, shards: int, records: int, shape: RecordShape) -> None:
    """`shard-000.bin` and so on, each written by a task of its own."""
    if shards < 1 or records < 1:
        raise EmptySource(path=directory)
    os.makedirs(directory, exist_ok=True)

    per, last = max(1, BLOCK // shape.bytes_per_record), np.arange(shape.values, dtype=np.float32)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in batch.column(0).to_pylist():
                with open(os.path.join(directory, f"shard-{k:03d}.bin"), "wb") as f:
                    for low in range(k * records, (k + 1) * records, per):
                        g = np.arange(low, min(low + per, (k + 1) * records)).astype(np.float32)
                        f.write(memoryview(encoded(g[:, None] + last, shape.encoding)).cast("B"))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int64())})

    spark.range(0, shards, 1, shards).mapInArrow(write, "shard bigint").agg(F.count(F.lit(1))).collect()
