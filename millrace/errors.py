"""What can go wrong, by the part that reports it."""

from __future__ import annotations

import errno
from collections.abc import Iterator


class MillraceError(Exception):
    """Base of all errors; keyword arguments become attributes and the message."""

    message = "{}"

    def __init__(self, **facts):
        self.facts = facts
        for name, value in facts.items():
            setattr(self, name, value)
        super().__init__(self.message.format(**facts) if facts else self.message)


def _error(base: type, name: str, message: str) -> type:
    return type(name, (base,), {"message": message, "__module__": __name__, "__doc__": message})


class CorpusError(MillraceError):
    """A corpus, its shape or its files are not as they must be."""


class TransformError(MillraceError):
    """A transform's source or destination is not as it must be."""


class SampleError(MillraceError):
    """A sampling request cannot be met."""


class QuantiseError(MillraceError):
    """A quantisation request cannot be met."""


class FuzzError(MillraceError):
    """A noise request cannot be met."""


class PipelineError(MillraceError):
    """A pipeline cannot be planned or run."""


class ManifestError(MillraceError):
    """A manifest or its metadata is malformed."""


class VerifyError(MillraceError):
    """A published corpus breaks an invariant."""


class BenchError(MillraceError):
    """A measurement cannot be taken or compared."""


InvalidRecordShape = _error(CorpusError, "InvalidRecordShape", "a record needs inputs and outputs, not {inputs} and {outputs}")
EmptySource = _error(CorpusError, "EmptySource", "{path} holds no records")
PartialRecord = _error(CorpusError, "PartialRecord", "{path} has {byte_len} bytes, {trailing_bytes} more than whole records of {bytes_per_record}")
RecordIndexOutOfRange = _error(CorpusError, "RecordIndexOutOfRange", "record {index} of {record_count}")
EmptySourceList = _error(CorpusError, "EmptySourceList", "no source files were given")
RecordLengthMismatch = _error(CorpusError, "RecordLengthMismatch", "{path}: a record of {actual} values, not {expected}")
UnsupportedSourceKind = _error(CorpusError, "UnsupportedSourceKind", "{path} is neither a file nor a directory")
NoSources = _error(CorpusError, "NoSources", "{path} holds no files")
DestinationIsSource = _error(CorpusError, "DestinationIsSource", "{path} is a source")
InvalidDestination = _error(CorpusError, "InvalidDestination", "{path} cannot be written to")
NoCorpusFiles = _error(TransformError, "NoCorpusFiles", "{path} holds no .bin files")
OverlappingCorpora = _error(TransformError, "OverlappingCorpora", "{output} and {source} overlap")
PublishFailed = _error(TransformError, "PublishFailed", "{staging} could not become {destination}")
StorageFull = _error(TransformError, "StorageFull", "storage is full; {required_bytes} bytes are needed")
InvalidRate = _error(SampleError, "InvalidRate", "a rate is over 0 and at most 1, not {rate}")
UnknownScheme = _error(QuantiseError, "UnknownScheme", "unknown scheme {scheme}")
SourceEncodingMismatch = _error(TransformError, "SourceEncodingMismatch", "{manifest} declares {found}, not {expected}")
SourceWidthMismatch = _error(TransformError, "SourceWidthMismatch", "{manifest} declares records of {found} values, not {expected}")
UnknownDistribution = _error(FuzzError, "UnknownDistribution", "unknown distribution {distribution}")
UnknownMode = _error(FuzzError, "UnknownMode", "unknown mode {mode}")
UnknownTargets = _error(FuzzError, "UnknownTargets", "unknown targets {targets}")
InvalidScale = _error(FuzzError, "InvalidScale", "a scale is finite and over 0, not {scale}")
InvalidBounds = _error(FuzzError, "InvalidBounds", "bounds are finite and in order, not {low} and {high}")
NonFiniteResult = _error(FuzzError, "NonFiniteResult", "record {record}, value {value}: {original} became {perturbed}")
EmptyPipeline = _error(PipelineError, "EmptyPipeline", "a pipeline needs a stage")
UnsupportedConfigVersion = _error(PipelineError, "UnsupportedConfigVersion", "configuration version {found}, not {expected}")
InvalidConfig = _error(PipelineError, "InvalidConfig", "{detail}")
StageFailed = _error(PipelineError, "StageFailed", "pipeline stage {position} ({name}): {cause}")
InvalidMetadata = _error(ManifestError, "InvalidMetadata", "metadata {entry!r}: {reason}")
InvalidManifest = _error(ManifestError, "InvalidManifest", "{path}: {detail}")
InvariantBroken = _error(VerifyError, "InvariantBroken", "{check}: {detail}")
CommandFailed = _error(VerifyError, "CommandFailed", "{label} ended with {code}")
Incomparable = _error(BenchError, "Incomparable", "{detail}")
Regression = _error(BenchError, "Regression", "{detail}")


def chain(error: BaseException | None) -> Iterator[BaseException]:
    """An error and those that it came from."""
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        yield error
        error = error.__cause__ or error.__context__


def storage_full(error: BaseException) -> bool:
    """Whether storage ran out anywhere below, also in a task, whose error arrives as text."""
    return any(isinstance(e, StorageFull) or isinstance(e, OSError) and e.errno == errno.ENOSPC or "No space left on device" in str(e) for e in chain(error))
