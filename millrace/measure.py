"""Measurements of transforms and their comparison with a baseline, as frames with a row per case."""

from __future__ import annotations

import json
import os
import resource
import subprocess
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import CommandFailed, Incomparable, Regression

#: Seconds between looks at a child's memory.
LOOK = 0.05

CASES = "label string, elapsed_ms bigint, peak_rss_kib bigint, input_bytes bigint, output_bytes bigint, records_read bigint, records_written bigint"


def measured(label: str, run: Callable[[], dict], repeats: int, input_bytes: int) -> dict:
    """The fastest of `repeats` runs, with the driver's largest memory; every run must read and write the same."""
    best, seen = None, None
    for _ in range(repeats):
        began = time.perf_counter()
        made = run()
        elapsed = int((time.perf_counter() - began) * 1000)
        now = (made["source"]["record_count"], made["output"]["record_count"], made["output"]["bytes"])
        if seen not in (None, now):
            raise Incomparable(detail=f"{label}: runs wrote {seen} and {now}")
        seen, best = now, elapsed if best is None else min(best, elapsed)
    rss = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return {"label": label, "elapsed_ms": best, "peak_rss_kib": rss, "input_bytes": input_bytes, "output_bytes": seen[2], "records_read": seen[0], "records_written": seen[1]}


def _tree(pid: int) -> list[int]:
    """A process and all that descend from it."""
    found = [pid]
    for p in found:
        try:
            for task in os.listdir(f"/proc/{p}/task"):
                with open(f"/proc/{p}/task/{task}/children") as f:
                    found += [c for c in map(int, f.read().split()) if c not in found]
        except OSError:  # it has ended
            continue
    return found


def _high_water(pid: int) -> int:
    """The most memory in KiB that a process has had resident, 0 once it has ended."""
    try:
        with open(f"/proc/{pid}/status") as f:
            return next((int(line.split()[1]) for line in f if line.startswith("VmHWM:")), 0)
    except OSError:
        return 0


def child(label: str, command: list[str], env: dict[str, str] | None = None) -> dict:
    """Run a command and wait for it: label, elapsed_ms, peak_rss_kib, exit code and what it printed.

    The peak is summed over the process and its children, a JVM and its workers among them, each at its own high-water
    mark; a child that lives for less than LOOK may be missed.
    """
    with tempfile.TemporaryFile("w+") as out, tempfile.TemporaryFile("w+") as err:
        began = time.perf_counter()
        run, peaks = subprocess.Popen(command, stdout=out, stderr=err, env=env), {}
        while run.poll() is None:
            for pid in _tree(run.pid):
                peaks[pid] = max(peaks.get(pid, 0), _high_water(pid))
            time.sleep(LOOK)
        elapsed = int((time.perf_counter() - began) * 1000)
        out.seek(0)
        err.seek(0)
        return {"label": label, "elapsed_ms": elapsed, "peak_rss_kib": sum(peaks.values()), "code": run.returncode, "output": out.read(), "error": err.read()}


def measured_child(label: str, command: list[str], repeats: int, facts: Callable[[], dict], input_bytes: int, env: dict[str, str] | None = None) -> dict:
    """The fastest of `repeats` runs of a command with the worst of their peaks, as a case. `facts` reads the manifest
    that a run published; all runs must agree in records and bytes, and each must end well."""
    best, seen, peak = None, None, 0
    for _ in range(repeats):
        run = child(label, command, env)
        if run["code"]:
            raise CommandFailed(label=label, code=run["code"])
        made = facts()
        now = (made["source"]["record_count"], made["output"]["record_count"], made["output"]["bytes"])
        if seen not in (None, now):
            raise Incomparable(detail=f"{label}: runs wrote {seen} and {now}")
        seen, peak, best = now, max(peak, run["peak_rss_kib"]), run["elapsed_ms"] if best is None else min(best, run["elapsed_ms"])
    return {"label": label, "elapsed_ms": best, "peak_rss_kib": peak, "input_bytes": input_bytes, "output_bytes": seen[2], "records_read": seen[0], "records_written": seen[1]}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def derived(cases: DataFrame) -> DataFrame:
    """Cases with records/s, GiB/s and output ratio; zero where time or input is."""
    seconds = F.col("elapsed_ms") / 1000
    return cases.withColumns({
        "records_per_second": _ratio(F.col("records_read"), seconds),
        "gib_per_second": _ratio(F.col("input_bytes") / float(1 << 30), seconds),
        "output_ratio": _ratio(F.col("output_bytes").cast("double"), F.col("input_bytes")),
    })


def ratios(base: DataFrame, current: DataFrame) -> DataFrame:
    """(label, speed, memory, size, in_base, in_current) over all labels of both: what current has of base's records/s,
    memory and output bytes; null where either is missing or base has none."""
    a, b = (derived(x).select("label", *[F.col(c).alias(f"{c}_{k}") for c in ("records_per_second", "peak_rss_kib", "output_bytes")], F.lit(True).alias(f"in_{k}")) for x, k in ((base, "a"), (current, "b")))
    both = a.join(b, "label", "full_outer")
    names = {"speed": "records_per_second", "memory": "peak_rss_kib", "size": "output_bytes"}
    found = {k: F.when(F.col(f"{c}_a") > 0, F.col(f"{c}_b") / F.col(f"{c}_a")) for k, c in names.items()}
    return both.select("label", *[c.alias(k) for k, c in found.items()], F.col("in_a").isNotNull().alias("in_base"), F.col("in_b").isNotNull().alias("in_current"))


def compared(base: DataFrame, current: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(label, speed, memory, size, verdict): `regression` if records/s fell, or memory or output rose, by more than
    the tolerance, or if the case is gone; `new` if only now there; else `ok`."""
    if not 0 <= tolerance < 1:
        raise Incomparable(detail=f"a tolerance is from 0 to under 1, not {tolerance}")
    worse = F.coalesce((F.col("speed") < 1 - tolerance) | (F.col("memory") > 1 + tolerance) | (F.col("size") > 1 + tolerance), F.lit(False))
    verdict = F.when(~F.col("in_current"), "regression").when(~F.col("in_base"), "new").when(worse, "regression").otherwise("ok")
    return ratios(base, current).select("label", "speed", "memory", "size", verdict.alias("verdict"))


def unlike(base: DataFrame, current: DataFrame) -> DataFrame:
    """Labels of cases in both that did not read the same corpus, by its bytes and records."""
    a, b = (x.select("label", F.struct("input_bytes", "records_read").alias(k)) for x, k in ((base, "a"), (current, "b")))
    return a.join(b, "label").where(~F.col("a").eqNullSafe(F.col("b"))).select("label")


def hold(base: DataFrame, current: DataFrame, tolerance: float = 0.25, shapes: tuple | None = None) -> None:
    """Raise for cases that got worse, and refuse to compare runs over unlike corpora, or over records of two `shapes`
    (the base's and the current one's) that differ."""
    if shapes and shapes[0] != shapes[1]:
        raise Incomparable(detail=f"records of {shapes[0]} and of {shapes[1]}")
    if other := [r["label"] for r in unlike(base, current).orderBy("label").collect()]:
        raise Incomparable(detail=f"other corpora: {', '.join(other)}")
    bad = [r["label"] for r in compared(base, current, tolerance).where("verdict = 'regression'").orderBy("label").collect()]
    if bad:
        raise Regression(detail=", ".join(bad))


def markdown(cases: DataFrame) -> str:
    rows = derived(cases).orderBy("label").collect()
    lines = ["| case | ms | records/s | GiB/s | output ratio | peak KiB |", "| --- | --- | --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {r['label']} | {r['elapsed_ms']} | {r['records_per_second']:.0f} | {r['gib_per_second']:.3f} | {r['output_ratio']:.3f} | {r['peak_rss_kib']} |" for r in rows]) + "\n"


def as_json(cases: DataFrame) -> str:
    return json.dumps([r.asDict() for r in derived(cases).orderBy("label").collect()], indent=2) + "\n"


def speed_up(cases: DataFrame, label: str, reference: str) -> dict:
    """How many times the records/s of `reference` a case reaches, and its share of that one's memory."""
    found = {r["label"]: r for r in derived(cases.where(F.col("label").isin(label, reference))).collect()}
    if gone := {label, reference} - set(found):
        raise Incomparable(detail=f"no case {', '.join(sorted(gone))}")
    ours, theirs = found[label], found[reference]
    if not theirs["records_per_second"] or not theirs["peak_rss_kib"]:
        raise Incomparable(detail=f"{reference} has no speed or no memory to compare with")
    return {"times": ours["records_per_second"] / theirs["records_per_second"], "memory_share": ours["peak_rss_kib"] / theirs["peak_rss_kib"]}


def hold_speed_up(cases: DataFrame, label: str, reference: str, at_least: float) -> None:
    found = speed_up(cases, label, reference)["times"]
    if found < at_least:
        raise Regression(detail=f"{label} reaches {found:.2f} times the records/s of {reference}, not {at_least}")
