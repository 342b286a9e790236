"""Soak: rounds of sampling over one corpus, each published over the last and verified, with the evidence that the
source stays as it was and that a run that fails leaves what was published before, and no scratch."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from .errors import InvariantBroken, MillraceError
from .shape import RecordShape
from .sources.discover import discover
from .sources.publish import write_synthetic
from .sources.verify import digests, verify
from .transforms import run_stage

#: A fault: given the source of a run, its shape and its stage, makes it fail; returns the stage to run and what undoes it.
Fault = Callable[[str, RecordShape, dict], tuple[dict, Callable[[], None]]]


def cut_short(source: str, shape: RecordShape, spec: dict) -> tuple[dict, Callable[[], None]]:
    """A file of one record and one byte, which the driver meets."""
    path = os.path.join(source, "zz-cut.bin")
    with open(path, "wb") as f:
        f.write(bytes(shape.bytes_per_record + 1))
    return spec, lambda: os.unlink(path)


def out_of_range(source: str, shape: RecordShape, spec: dict) -> tuple[dict, Callable[[], None]]:
    """Noise that no value stays finite under, which tasks meet while they write."""
    return {"transform": "fuzz", "distribution": "gaussian", "scale": 1e300, "mode": "absolute"}, lambda: None


FAULTS: dict[str, Fault] = {"a file cut short": cut_short, "noise out of range": out_of_range}


def state(spark: SparkSession, directory: str) -> dict[str, str]:
    """Digest by name of every file of a corpus, its manifest included."""
    names = [f.name for f in discover(directory)]
    return {r["name"]: r["sha256"] for r in digests(spark, directory, names).collect()}


def scratch(directory: str) -> list[str]:
    return sorted(n for n in os.listdir(directory) if ".staging-" in n or ".deleting-" in n)


def hold(ok: bool, check: str, detail: str) -> None:
    if not ok:
        raise InvariantBroken(check=check, detail=detail)


def soak(spark: SparkSession, workspace: str, shape: RecordShape, shards: int, records: int, rounds: int, rate: float, faults: dict[str, Fault] | None = None) -> dict:
    """The evidence of `rounds` samples at `rate` over a synthetic corpus, as a report; the first broken invariant raises."""
    source, output = os.path.join(workspace, "source"), os.path.join(workspace, "sample")
    write_synthetic(spark, source, shards, records, shape)
    before, spec, told = state(spark, source), {"transform": "sample", "rate": rate}, []
    for k in range(1, rounds + 1):
        began = time.perf_counter()
        made = run_stage(spark, source, output, shape, spec)
        elapsed = time.perf_counter() - began
        verify(spark, output, shape)
        told.append({"round": k, "elapsed_ms": int(elapsed * 1000), "records_per_second": round(shards * records / elapsed), "seed": str(made["transform"]["seed"]), "records_kept": made["output"]["record_count"], "bytes": made["output"]["bytes"]})
    hold(state(spark, source) == before, "source immutability", f"{source} changed")
    injected = []
    for name, fault in (FAULTS if faults is None else faults).items():
        published = state(spark, output)
        broken, undo = fault(source, shape, spec)
        try:
            run_stage(spark, source, output, shape, broken)
            failed = None
        except MillraceError as e:
            failed = type(e).__name__
        finally:
            undo()
        hold(failed is not None, "fail loud", f"{name}: a corpus was published")
        hold(state(spark, output) == published, "atomic publication", f"{name}: {output} changed")
        injected.append({"fault": name, "error": failed, "previous_corpus_intact": True})
    hold(state(spark, source) == before, "source immutability", f"{source} changed")
    left = scratch(workspace)
    hold(not left, "scratch", ", ".join(left))
    facts = {"shards": shards, "records_per_shard": records, "bytes": shards * records * shape.bytes_per_record}
    return {"record_shape": shape.as_dict(), "rate": rate, "corpus": facts, "rounds": told, "faults": injected, "source_unchanged": True, "scratch_left_behind": len(left)}


def markdown(report: dict) -> str:
    lines = [f"Corpus: {report['corpus']['shards']} x {report['corpus']['records_per_shard']} records, {report['corpus']['bytes']} bytes; rate {report['rate']}.", ""]
    lines += ["| round | ms | records/s | kept | seed |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {r['round']} | {r['elapsed_ms']} | {r['records_per_second']} | {r['records_kept']} | {r['seed']} |" for r in report["rounds"]]
    lines += ["", "| fault | error | previous corpus |", "| --- | --- | --- |"]
    lines += [f"| {f['fault']} | {f['error']} | {'intact' if f['previous_corpus_intact'] else 'changed'} |" for f in report["faults"]]
    return "\n".join([*lines, "", f"Source unchanged: {report['source_unchanged']}. Scratch left behind: {report['scratch_left_behind']}.", ""])


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2) + "\n"
