"""Derived corpora planned over positions: which records one has, and in what order, follows from positions alone.

What nothing is sampled from is run as ranges of positions, a row per task; a sample moves some bytes per record that
it keeps. Values are read by the tasks that write them and pass through all stages there, each stage handing on what
its encoding can hold, as if it had been published and read again. A task tells one row: its piece, what each stage
counted, and the first value that a stage could not keep finite; nothing is raised in a task, so the least failure of
all tasks is known, and its type survives.
"""

from __future__ import annotations

import errno
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NonFiniteResult, StageFailed, StorageFull
from ..functions import bf16
from ..functions.draws import record_key, record_uniform
from ..operators.records import arrow_schema
from ..operators.sample import file_order
from ..plans.pipeline import Stage
from ..shape import Encoding, RecordShape
from .discover import SourceFile
from .publish import Piece, drop_strays

#: Bytes of records of one task, records' bytes that it holds at once, and the most tasks.
SPLIT, HELD, MOST_TASKS = 64 << 20, 4 << 20, 10_000

TOLD = (
    "part int, name string, records bigint, bytes bigint, sha256 string, counts array<bigint>, is_full boolean, "
    "stage int, record bigint, value int, original double, perturbed double"
)


@dataclass(frozen=True)
class Layout:
    """The records of a source's files end to end: its files, the position at which each starts, and their end."""

    paths: tuple[str, ...]
    starts: np.ndarray
    shape: RecordShape

    @classmethod
    def of(cls, files: list[SourceFile], counts: list[int], shape: RecordShape) -> Layout:
        return cls(tuple(f.path for f in files), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), shape)

    @property
    def total(self) -> int:
        return int(self.starts[-1])

    def files(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, pos, "right") - 1

    def read(self, handles: dict[int, int], pos: np.ndarray) -> np.ndarray:
        """Records x values at these positions; neighbours in a file are read together."""
        width, kind = self.shape.bytes_per_record, "<f4" if self.shape.encoding is Encoding.FLOAT32 else "<u2"
        out, files = np.empty((len(pos), self.shape.values), kind), self.files(pos)
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)], strict=True):
            f = int(files[a])
            if f not in handles:
                handles[f] = os.open(self.paths[f], os.O_RDONLY)
            into, at = memoryview(out[a:b]).cast("B"), int(pos[a] - self.starts[f]) * width
            while into:
                done = os.preadv(handles[f], [into], at)
                if not done:
                    raise EOFError(f"{self.paths[f]} ends at {at}")
                into, at = into[done:], at + done
        return out if kind == "<f4" else bf16.decode(out)


@dataclass(frozen=True)
class Step:
    """A stage that changes values: its place in the pipeline, the shape that it reads, and the column of a task's
    rows that has the positions it draws by, 0 for those in the source."""

    stage: Stage
    shape: RecordShape
    column: int

    def __call__(self, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int], NonFiniteResult | None]:
        return self.stage.change(values, at, self.shape)


def tasks(records: float, width: int, least: int = 1) -> int:
    """How many tasks to give so many records to."""
    return int(max(1, min(MOST_TASKS, max(least, -(-records * width // SPLIT)))))


def _read(layout: Layout, rows: Iterator[list[np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    handles: dict[int, int] = {}
    per = max(1, HELD // layout.shape.bytes_per_record)
    try:
        for columns in rows:
            for i in range(0, len(columns[0]), per):
                part = [c[i : i + per] for c in columns]
                yield part, layout.read(handles, part[0])
    finally:
        for f in handles.values():
            os.close(f)


def told(layout: Layout, steps: list[Step], shape: RecordShape, part: int, rows: Iterator[list[np.ndarray]], directory: str | None) -> dict:
    """One task's rows (positions in the source, and where its stages draw) through all steps into a piece of
    `directory`, or only through the steps where that is None."""
    counts, first, full = np.zeros((len(steps), 3), np.int64), None, False
    piece = Piece(directory, shape) if directory else None
    try:
        for columns, values in _read(layout, rows):
            for k, step in enumerate(steps):
                if first and first[0] < step.stage.position:
                    break  # a stage fails before the next one starts
                values, counted, failure = step(values, columns[step.column])
                counts[k] += counted
                if failure:
                    found = (step.stage.position, failure.record, failure.value, failure.original, failure.perturbed)
                    first = found if first is None else min(first, found)
                    break
            if piece and first is None:
                piece.write(values)
        if piece:
            piece.close(keep=first is None)
    except OSError as e:
        if e.errno != errno.ENOSPC:
            raise
        full = True
        piece.close(keep=False)
    names = ("stage", "record", "value", "original", "perturbed")
    facts = piece.facts() if piece else {"name": None, "records": 0, "bytes": 0, "sha256": None}
    return {"part": part, **facts, "counts": counts.ravel().tolist(), "is_full": full, **dict(zip(names, first or [None] * 5, strict=True))}


class Gather:
    """Planned stages over a source, and what running them told."""

    def __init__(self, spark: SparkSession, files: list[SourceFile], counts: list[int], shape: RecordShape, stages: list[Stage]):
        self.spark, self.layout, self.stages = spark, Layout.of(files, counts, shape), stages
        self.least = spark.sparkContext.defaultParallelism
        self.rows: DataFrame | None = None  # src, pos where a later stage draws by it, and a column for each that does
        self.steps: list[Step] = []
        self.dropped: list[tuple[DataFrame, list[Step]]] = []
        records, at = float(self.layout.total), []
        for k, stage in enumerate(stages):
            if stage.change is None:
                rows = self.rows if self.rows is not None else self._all()
                rate, drawn = stage.parameters["rate"], record_uniform(stage.seed, "keep", "pos")
                if any(s.stage.seed is not None for s in self.steps):  # records that go may have failed before
                    self.dropped.append((rows.where(drawn >= rate).select("src", *at), list(self.steps)))
                records *= rate
                numbered = any(s.seed is not None for s in stages[k + 1 :])
                self.rows = self._shuffled(rows.where(drawn < rate), stage.seed, k == 0, tasks(records, stage.reshape(shape).bytes_per_record, self.least), numbered, at)
            else:
                column = 0
                if self.rows is not None and stage.seed is not None:
                    self.rows = self.rows.withColumn(f"at{k}", F.col("pos"))
                    at.append(f"at{k}")
                    column = len(at)
                self.steps.append(Step(stage, shape, column))
            shape = stage.reshape(shape)
        self.shape, self.columns = shape, at

    def _all(self) -> DataFrame:
        n = tasks(self.layout.total, 8, self.least)
        return self.spark.range(0, self.layout.total, 1, n).select(F.col("id").alias("src"), F.col("id").alias("pos"))

    def _shuffled(self, kept: DataFrame, seed: int, whole: bool, n: int, numbered: bool, at: list[str]) -> DataFrame:
        """Kept records in a sample's order: files shuffled, and each one's records by their keys; what an earlier
        stage made is one file, so only the first stage has the source's files (`whole`). Keys are uniform, so the task
        of a record follows from its file's share of the source and its key, and one exchange puts tasks, and within
        them records, in order."""
        layout = self.layout
        place = np.zeros(len(layout.paths), np.int64)
        place[file_order(seed, len(layout.paths))] = np.arange(len(layout.paths))
        share = np.diff(layout.starts) / max(1, layout.total)
        begins = np.zeros(len(share))
        begins[np.argsort(place)] = np.concatenate([[0.0], np.cumsum(share[np.argsort(place)])[:-1]])
        named = ["src", "pos", *at]
        drawn = kept.select(*named, record_key(seed, "order", "pos").alias("key"), record_uniform(seed, "order", "pos").alias("u"))

        def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                u = batch.column("u").to_numpy()
                file = layout.files(batch.column("pos").to_numpy()) if whole else np.zeros(len(u), np.int64)
                to = np.minimum((n * (begins[file] + share[file] * u if whole else u)).astype(np.int32), n - 1)
                rank = place[file] if whole else file
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*named, "key")), pa.array(rank), pa.array(to)], names=[*named, "key", "file", "task"])

        schema = ", ".join(f"{c} bigint" for c in named) + ", key string, file bigint, task int"
        placed = drawn.mapInArrow(dealt, schema)
        rows = placed.repartitionById(n, F.col("task")).sortWithinPartitions("file", "key", "pos").select("task", *named)
        if not numbered:
            return rows.drop("task", "pos")
        counted = {r["task"]: r["count"] for r in placed.groupBy("task").count().collect()}  # a row per task
        starts = np.concatenate([[0], np.cumsum([counted.get(k, 0) for k in range(n)])])

        def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = 0
            for batch in it:
                if batch.num_rows:
                    new = starts[batch.column("task")[0].as_py()] + done + np.arange(batch.num_rows)
                    done += batch.num_rows
                    yield pa.RecordBatch.from_arrays([batch.column("src"), pa.array(new), *(batch.column(c) for c in at)], names=named)

        return rows.mapInArrow(number, ", ".join(f"{c} bigint" for c in named))

    def run(self, directory: str) -> tuple[list[dict], list[dict]]:
        """Write the corpus as pieces of `directory`: the pieces in order, and what each stage that draws counted.

        Raises StageFailed for the least failure by stage, record and value, and StorageFull with the bytes written.
        """
        layout, steps, shape = self.layout, self.steps, self.shape
        schema = arrow_schema(TOLD)
        if self.rows is None:
            n = tasks(layout.total, max(layout.shape.bytes_per_record, shape.bytes_per_record), self.least)
            per = max(1, HELD // layout.shape.bytes_per_record)

            def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in it:
                    for k in batch.column(0).to_pylist():
                        first, end = layout.total * k // n, layout.total * (k + 1) // n
                        rows = ([np.arange(i, min(i + per, end))] for i in range(first, end, per))
                        yield pa.RecordBatch.from_pylist([told(layout, steps, shape, k, rows, directory)], schema)

            made = self.spark.range(0, n, 1, n).mapInArrow(ranges, TOLD)
        else:
            made = self.rows.select("src", *self.columns).mapInArrow(_task(layout, steps, shape, directory), TOLD)
        for rows, before in self.dropped:
            made = made.unionByName(rows.mapInArrow(_task(layout, before, shape, None), TOLD))
        found = made.collect()  # a row per task
        if failed := [r for r in found if r["stage"] is not None]:
            least = min(failed, key=lambda r: (r["stage"], r["record"], r["value"]))
            cause = NonFiniteResult(**{k: least[k] for k in ("record", "value", "original", "perturbed")})
            raise StageFailed(position=least["stage"], name=self.stages[least["stage"] - 1].name, cause=cause)
        if any(r["is_full"] for r in found):
            raise StorageFull(required_bytes=sum(r["bytes"] for r in found))
        pieces = sorted(({k: r[k] for k in ("part", "name", "records", "bytes", "sha256")} for r in found if r["records"] and r["name"]), key=lambda p: p["part"])
        drop_strays(directory, {p["name"] for p in pieces})
        counted = [sum(np.array(r["counts"], np.int64).reshape(-1, 3)[k] for r in found if len(r["counts"]) > 3 * k) for k in range(len(steps))]
        names = ("perturbed", "clamped", "preserved")
        return pieces, [{"stage": s.stage.position} | dict(zip(names, map(int, c), strict=True)) for s, c in zip(steps, counted, strict=True) if s.stage.seed is not None]


def _task(layout: Layout, steps: list[Step], shape: RecordShape, directory: str | None) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ([c.to_numpy() for c in batch.columns] for batch in it)
        yield pa.RecordBatch.from_pylist([told(layout, steps, shape, TaskContext.get().partitionId(), rows, directory)], arrow_schema(TOLD))

    return run
