"""The four transforms from a corpus on disk to a derived one: check, plan, run, publish."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .errors import StageFailed, StorageFull, storage_full
from .functions.draws import fresh_seed
from .operators import sample as sampling
from .plans.pipeline import VERSION, Pipeline, Stage
from .shape import RecordShape
from .sources import manifest as manifests
from .sources.discover import SourceFile, checked_destination, corpus_files, record_counts
from .sources.gather import Gather
from .sources.publish import publish
from .sources.verify import check_declaration


class Outcome(dict):
    """The manifest of a published corpus, with `counts`: for each stage that adds noise its position and how many
    values it perturbed, clamped ones too, clamped, and preserved as not finite."""

    counts: list[dict]


def run_pipeline(spark: SparkSession, source: str, output: str, shape: RecordShape, pipeline: Pipeline, seed: int | None = None, metadata: dict | None = None, single_file: bool = False) -> Outcome:
    """Run all stages as one plan and publish once. A stage that fails raises StageFailed with its position."""
    given = next((s for s in (seed, pipeline.seed) if s is not None), None)
    seed = fresh_seed() if given is None else given
    stages = pipeline.plan(seed, shape.encoding)
    transform = {"name": "pipeline", "parameters": {"config_version": VERSION, "stage_count": len(stages)}, "seed": seed}
    return _run(spark, source, output, shape, stages, transform, [s.record() for s in stages], metadata, single_file)


def run_stage(spark: SparkSession, source: str, output: str, shape: RecordShape, spec: dict, metadata: dict | None = None, single_file: bool = False) -> Outcome:
    """Run one transform (a stage's specification) and publish. A failure raises its own error."""
    drawn = spec if spec["transform"] == "quantise" or spec.get("seed") is not None else spec | {"seed": fresh_seed()}
    try:
        stages = Pipeline((drawn,)).plan(0, shape.encoding)
        return _run(spark, source, output, shape, stages, stages[0].record(), None, metadata, single_file)
    except StageFailed as e:
        raise e.cause from e


def _run(spark: SparkSession, source: str, output: str, shape: RecordShape, stages: list[Stage], transform: dict, listed: list[dict] | None, metadata: dict | None, single_file: bool) -> Outcome:
    destination = checked_destination(source, output)
    check_declaration(source, shape)
    files = corpus_files(source)
    counts = record_counts(files, shape)
    gather, told = Gather(spark, files, counts, shape, stages), []
    first = stages[0]
    processed = [files[k] for k in sampling.file_order(first.seed, len(files))] if first.name == "sample" else files
    identity = manifests.source_identity(source, processed, sum(counts))

    def pieces(directory: str) -> list[dict]:
        made, counted = gather.run(directory)
        told.extend(counted)
        return made

    try:
        made = publish(None, gather.shape, destination, stages[-1].file_name, transform, identity, metadata or {}, shape, listed, single_file, pieces)
    except Exception as e:  # the driver's own writes can find the disk full as well
        if storage_full(e):
            raise StorageFull(required_bytes=max(whole_pass(stages, files, gather), getattr(e, "required_bytes", 0))) from e
        raise
    out = Outcome(made)
    out.counts = told
    return out


def whole_pass(stages: list[Stage], files: list[SourceFile], gather: Gather) -> int:
    """Bytes that a whole attempt is expected to write."""
    width, size = gather.shape.bytes_per_record, gather.layout.total * gather.shape.bytes_per_record
    for stage in stages:
        if stage.name == "sample":
            size = sampling.expected_bytes(size, width, stage.parameters["rate"])
    return size
