"""Command line: python -m millrace.cli sample|quantise|fuzz|pipeline --source DIR --output DIR --inputs N --outputs N."""

from __future__ import annotations

import argparse
import sys

from .errors import chain, storage_full
from .plans.pipeline import Pipeline
from .shape import RecordShape
from .sources.manifest import parse_metadata
from .transforms import run_pipeline, run_stage

STORAGE_FULL = 28


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description="Derive training corpora from fixed-width records.")
    top.add_argument("--source", required=True)
    top.add_argument("--output", required=True)
    top.add_argument("--inputs", type=int, required=True)
    top.add_argument("--outputs", type=int, required=True)
    top.add_argument("--metadata", action="append", default=[], metavar="KEY=VALUE")
    top.add_argument("--single-file", action="store_true", help="publish one file, hashed from end to end, instead of numbered ones, each hashed by its task")
    kinds = top.add_subparsers(dest="transform", required=True)
    sample = kinds.add_parser("sample")
    sample.add_argument("--rate", type=float, required=True)
    sample.add_argument("--seed", type=int)
    kinds.add_parser("quantise").add_argument("--scheme", required=True)
    fuzz = kinds.add_parser("fuzz")
    fuzz.add_argument("--distribution", required=True)
    fuzz.add_argument("--scale", type=float, required=True)
    fuzz.add_argument("--mode", required=True)
    fuzz.add_argument("--targets", default="inputs")
    fuzz.add_argument("--clamp-min", type=float)
    fuzz.add_argument("--clamp-max", type=float)
    fuzz.add_argument("--seed", type=int)
    kinds.add_parser("pipeline").add_argument("--config", required=True)
    return top


def exit_code(error: BaseException) -> int:
    """28 if storage ran out, else 1."""
    return STORAGE_FULL if storage_full(error) else 1


def required_bytes(error: BaseException) -> int | None:
    return next((e.required_bytes for e in chain(error) if hasattr(e, "required_bytes")), None)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        shape, metadata = RecordShape(args.inputs, args.outputs), parse_metadata(args.metadata)
        pipeline = Pipeline.load(args.config) if args.transform == "pipeline" else None
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("millrace").getOrCreate()
        if pipeline is not None:
            made = run_pipeline(spark, args.source, args.output, shape, pipeline, metadata=metadata, single_file=args.single_file)
        else:
            skipped = {"source", "output", "inputs", "outputs", "metadata", "single_file"}
            spec = {k: v for k, v in vars(args).items() if k not in skipped and v is not None}
            made = run_stage(spark, args.source, args.output, shape, spec, metadata, args.single_file)
    except Exception as e:  # ours, the system's, and Spark's, whose causes are text
        return _report(e)
    print(f"records read: {made['source']['record_count']}")
    print(f"records written: {made['output']['record_count']}")
    if "seed" in made["transform"]:
        print(f"seed: {made['transform']['seed']}")
    for told in made.counts:
        print(f"stage {told['stage']}: perturbed {told['perturbed']}, clamped {told['clamped']}, preserved {told['preserved']}")
    for f in made["output"].get("files", [made["output"]]):
        print(f"sha256: {f['checksum']['value']}")
    return 0


def _report(error: BaseException) -> int:
    code = exit_code(error)
    print(f"error: {error}", file=sys.stderr)
    if code == STORAGE_FULL and (needed := required_bytes(error)) is not None:
        print(f"required_bytes={needed}", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
