"""Checks of published corpora and of their sources."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvariantBroken, SourceEncodingMismatch, SourceWidthMismatch
from ..shape import RecordShape
from . import manifest as manifests

#: The most tasks that hash files.
TASKS = 10_000


def check_declaration(directory: str, shape: RecordShape) -> None:
    """A source that has a manifest must hold what the caller says; one without is taken at the caller's word."""
    found = manifests.beside(directory) if os.path.isdir(directory) else None
    if found is None:
        return
    path, declared = os.path.join(directory, manifests.FILE), found["record_shape"]
    if declared["encoding"] != shape.encoding.value:
        raise SourceEncodingMismatch(manifest=path, expected=shape.encoding.value, found=declared["encoding"])
    if declared["record_values"] != shape.values:
        raise SourceWidthMismatch(manifest=path, expected=shape.values, found=declared["record_values"])


def digests(spark: SparkSession, directory: str, names: list[str]) -> DataFrame:
    """(name, bytes, sha256) of files, each read as a stream by one task, so that none is held whole."""
    paths = [os.path.join(directory, n) for n in names]

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in batch.column(0).to_pylist():
                with open(paths[k], "rb") as f:
                    found = {"name": [os.path.basename(paths[k])], "bytes": [os.fstat(f.fileno()).st_size], "sha256": [hashlib.file_digest(f, "sha256").hexdigest()]}
                yield pa.RecordBatch.from_pydict(found)

    return spark.range(0, len(paths), 1, max(1, min(len(paths), TASKS))).mapInArrow(hashed, "name string, bytes bigint, sha256 string")


def verify(spark: SparkSession, directory: str, shape: RecordShape) -> dict:
    """The manifest of a corpus that is what it says; else the first broken invariant."""
    made = manifests.load(os.path.join(directory, manifests.FILE))
    output = made["output"]
    files = output.get("files") or [output]

    def hold(ok: bool, check: str, detail: str) -> None:
        if not ok:
            raise InvariantBroken(check=check, detail=f"{directory}: {detail}")

    hold(made["record_shape"] == shape.as_dict(), "record geometry", f"{made['record_shape']}")
    sizes = {f["file"]: os.path.getsize(os.path.join(directory, f["file"])) for f in files if f["file"]}
    total, width = sum(sizes.values()), shape.bytes_per_record
    hold(total == output["bytes"] and all(sizes[f["file"]] == f["bytes"] for f in files if f["file"]), "published bytes", f"{total}, not {output['bytes']}")
    hold(all(s % width == 0 for s in sizes.values()), "whole records", f"{total} bytes of {width}")
    hold(total // width == output["record_count"], "record count", f"{total // width}, not {output['record_count']}")
    found = {r["name"]: r["sha256"] for r in digests(spark, directory, list(sizes)).collect()} if sizes else {}
    hold(all(found[f["file"]] == f["checksum"]["value"] for f in files if f["file"]), "published checksum", "a file's digest differs")
    hold(output["record_count"] <= made["source"]["record_count"], "sample size", "more records than the source has")
    return made


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that two sets of digests do not share."""
    both = before.alias("b").join(after.alias("a"), "name", "full_outer")
    same = F.col("b.bytes").eqNullSafe(F.col("a.bytes")) & F.col("b.sha256").eqNullSafe(F.col("a.sha256"))
    return both.where(~same).select("name")


def not_contained(output: DataFrame, source: DataFrame) -> DataFrame:
    """Records of `output` that `source` lacks, each as often as it has too many."""
    def keyed(records: DataFrame) -> DataFrame:
        return records.select(F.sha2(F.array_join(F.transform("values", lambda v: v.cast("string")), ","), 256).alias("record"))

    return keyed(output).exceptAll(keyed(source))
