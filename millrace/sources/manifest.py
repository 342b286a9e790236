"""Manifests: what a published corpus is, where it came from and what was done to it."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import __version__
from ..errors import InvalidManifest, InvalidMetadata
from ..shape import RecordShape
from .discover import SourceFile

FILE, VERSION, TOOL = "manifest.json", 1, "millrace"
_KEY = re.compile(r"[A-Za-z0-9_.-]{1,64}\Z")


def parse_metadata(entries: Iterable[str]) -> dict[str, str]:
    """KEY=VALUE entries: keys of 1 to 64 letters, digits, `_.-`; values of at most 1024 bytes without controls."""
    out: dict[str, str] = {}
    for entry in entries:
        key, equals, value = entry.partition("=")
        for wrong, reason in (
            (not equals, "it has no ="),
            (not _KEY.match(key), "the key is not 1 to 64 of the letters allowed"),
            (len(value.encode()) > 1024, "the value is over 1024 bytes"),
            (any(ord(c) < 32 or 127 <= ord(c) < 160 for c in value), "the value has a control character"),
            (key in out, "the key is there twice"),
        ):
            if wrong:
                raise InvalidMetadata(entry=entry, reason=reason)
        out[key] = value
    return dict(sorted(out.items()))


def is_valid(entry: str) -> Column:
    """Whether each string of a column is an entry that `parse_metadata` takes."""
    first = F.instr(entry, "=")
    value = F.when(first > 0, F.substr(F.col(entry), first + 1))
    whole = F.col(entry).rlike(r"\A[A-Za-z0-9_.-]{1,64}=[^\x00-\x1F\x7F-\x9F]*\z")
    return F.coalesce(whole & (F.octet_length(value) <= 1024), F.lit(False))


def timestamp(unix: int) -> str:
    return datetime.fromtimestamp(unix, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def timestamp_of(unix: Column) -> Column:
    """`timestamp` of a column of seconds, whatever the session's time zone; also of years beyond 9999, which have all
    their digits and no sign."""
    second = F.pmod(unix, F.lit(86400))
    day = F.date_from_unix_date(((unix - second) / 86400).cast("int"))
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    year = F.year(day)
    year = F.when(year.between(0, 999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    clock = [two(n) for n in (second / 3600, second % 3600 / 60, second % 60)]
    return F.concat(F.concat_ws("-", year, two(F.month(day)), two(F.dayofmonth(day))), F.lit("T"), F.concat_ws(":", *clock), F.when(unix.isNotNull(), F.lit("Z")))


def source_identity(path: str, files: list[SourceFile], records: int) -> dict:
    listed = [{"name": f.name, "bytes": f.bytes} for f in files]
    return {"path": os.path.realpath(path), "identity_strategy": "path+bytes", "file_count": len(files), "record_count": records, "files": listed}


def build(transform: dict, shape: RecordShape, source: dict, output: dict, metadata: dict, source_shape: RecordShape | None = None, stages: list[dict] | None = None) -> dict:
    now = int(datetime.now(timezone.utc).timestamp())
    out = {
        "manifest_version": VERSION, "tool": {"name": TOOL, "version": __version__}, "created_at": timestamp(now),
        "created_at_unix": now, "transform": transform,
    }
    if stages is not None:
        out["pipeline"] = stages
    out["record_shape"] = shape.as_dict()
    if source_shape is not None and source_shape != shape:
        out["source_record_shape"] = source_shape.as_dict()
    return out | {"source": source, "output": output, "metadata": metadata}


def load(path: str) -> dict:
    """A manifest of the known version; unknown fields are let be."""
    try:
        with open(path, encoding="utf-8") as f:
            out = json.load(f)
    except ValueError as e:
        raise InvalidManifest(path=path, detail=str(e)) from e
    if not isinstance(out, dict) or out.get("manifest_version") != VERSION:
        raise InvalidManifest(path=path, detail="its version is not known")
    return out


def beside(directory: str) -> dict | None:
    path = os.path.join(directory, FILE)
    return load(path) if os.path.exists(path) else None


def write(manifest: dict, directory: str) -> str:
    path = os.path.join(directory, FILE)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=2)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    return path
