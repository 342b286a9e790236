"""Which files a corpus has, in which order, and whether a destination may be written."""

from __future__ import annotations

import os
from dataclasses import dataclass

from ..errors import DestinationIsSource, EmptySource, EmptySourceList, InvalidDestination, NoCorpusFiles, NoSources, OverlappingCorpora, PartialRecord, UnsupportedSourceKind
from ..shape import RecordShape


@dataclass(frozen=True)
class SourceFile:
    path: str
    bytes: int

    @property
    def name(self) -> str:
        return os.path.basename(self.path)


def discover(path: str) -> list[SourceFile]:
    """The file itself, or the regular files of a directory that aren't hidden, by the bytes of their names."""
    if os.path.isfile(path):
        return [SourceFile(path, os.path.getsize(path))]
    if not os.path.isdir(path):
        if not os.path.exists(path):
            raise FileNotFoundError(2, "no such source", path)
        raise UnsupportedSourceKind(path=path)
    with os.scandir(path) as entries:
        found = sorted((e.name for e in entries if e.is_file() and not e.name.startswith(".")), key=os.fsencode)
    if not found:
        raise NoSources(path=path)
    return [SourceFile(os.path.join(path, n), os.path.getsize(os.path.join(path, n))) for n in found]


def corpus_files(path: str) -> list[SourceFile]:
    """The `.bin` files of a corpus directory."""
    try:
        files = [f for f in discover(path) if f.name.endswith(".bin")]
    except NoSources:
        files = []
    if not files:
        raise NoCorpusFiles(path=path)
    return files


def record_counts(files: list[SourceFile], shape: RecordShape) -> list[int]:
    """Records per file, from sizes alone; no file may be empty or end within a record."""
    if not files:
        raise EmptySourceList()
    width = shape.bytes_per_record
    for f in files:
        if not f.bytes:
            raise EmptySource(path=f.path)
        if f.bytes % width:
            raise PartialRecord(path=f.path, byte_len=f.bytes, bytes_per_record=width, trailing_bytes=f.bytes % width)
    return [f.bytes // width for f in files]


def checked_destination(source: str, output: str) -> str:
    """The real path of `output`, which must have a name and a parent and not lie in the source, nor it in there."""
    name = os.path.basename(output.rstrip("/"))
    parent = os.path.dirname(os.path.abspath(output))
    if name in ("", ".", "..") or not os.path.isdir(parent):
        raise InvalidDestination(path=output)
    real, own = os.path.join(os.path.realpath(parent), name), os.path.realpath(source)
    real = os.path.realpath(real)
    if os.path.isfile(source) and real == own:
        raise DestinationIsSource(path=output)
    if real == own or real.startswith(own + os.sep) or own.startswith(real + os.sep):
        raise OverlappingCorpora(output=output, source=source)
    return real
