"""Noise on values under an explicit policy."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidBounds, InvalidScale, NonFiniteResult, UnknownDistribution, UnknownMode, UnknownTargets
from ..functions import bf16
from ..functions.draws import value_keys, value_uniforms
from ..shape import Encoding, RecordShape
from .records import arrow_schema, map_values


def _named(kind: type[Enum], name: str, error: type, what: str):
    try:
        return kind(name)
    except ValueError:
        raise error(**{what: name}) from None


class Distribution(Enum):
    GAUSSIAN = "gaussian"
    UNIFORM = "uniform"


class Mode(Enum):
    ABSOLUTE = "absolute"
    RELATIVE = "relative"


class Targets(Enum):
    INPUTS = "inputs"
    OUTPUTS = "outputs"
    ALL = "all"

    def mask(self, shape: RecordShape) -> np.ndarray:
        at = np.arange(shape.values) < shape.inputs
        return {Targets.INPUTS: at, Targets.OUTPUTS: ~at, Targets.ALL: np.ones(shape.values, bool)}[self]


@dataclass(frozen=True)
class Policy:
    """What noise, how much of it, on which values, and the bounds that results are held in (as float32)."""

    distribution: Distribution
    scale: float
    mode: Mode
    targets: Targets = Targets.INPUTS
    low: float | None = None
    high: float | None = None

    @classmethod
    def named(cls, distribution: str, scale: float, mode: str, targets: str = "inputs", low: float | None = None, high: float | None = None) -> Policy:
        return cls(
            _named(Distribution, distribution, UnknownDistribution, "distribution"), scale, _named(Mode, mode, UnknownMode, "mode"),
            _named(Targets, targets, UnknownTargets, "targets"), low, high,
        )

    def __post_init__(self):
        if not (math.isfinite(self.scale) and self.scale > 0):
            raise InvalidScale(scale=self.scale)
        with np.errstate(over="ignore"):
            held = [None if b is None else float(np.float32(b)) for b in (self.low, self.high)]
        if any(b is not None and not math.isfinite(b) for b in held) or None not in held and held[0] > held[1]:
            raise InvalidBounds(low=self.low, high=self.high)
        object.__setattr__(self, "low", held[0])
        object.__setattr__(self, "high", held[1])

    @property
    def file_name(self) -> str:
        return f"fuzz-{self.distribution.value}.bin"

    def parameters(self) -> dict:
        return {
            "distribution": self.distribution.value, "scale": self.scale, "mode": self.mode.value, "targets": self.targets.value,
            "clamp_min": self.low, "clamp_max": self.high, "non_finite_source": "preserve", "non_finite_result": "fail",
            "generator": "counter-mix32",
        }


def noise(policy: Policy, seed: int, pos: np.ndarray, n: int) -> np.ndarray:
    """Records x values: standard normal by Box-Muller, or uniform on [-1, 1)."""
    u, v = value_uniforms(value_keys(seed, "noise"), pos, n)
    return np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v) if policy.distribution is Distribution.GAUSSIAN else 2 * u - 1


@dataclass(frozen=True)
class Noised:
    """Values after noise, as the shape's encoding holds them; how many were perturbed (clamped ones too), clamped and
    preserved as not finite; and the first, by record and index, that stopped being finite."""

    values: np.ndarray
    counts: tuple[int, int, int]
    failure: NonFiniteResult | None


def noised(policy: Policy, shape: RecordShape, seed: int, values: np.ndarray, pos: np.ndarray) -> Noised:
    """Noise on records x values. A value that is not finite stays as it is; one that a bound holds is clamped, and
    rounding to the encoding comes last, as it does where the values are written."""
    x = values.astype(np.float64)
    step = policy.scale * noise(policy, seed, pos, values.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        made = (x + step if policy.mode is Mode.ABSOLUTE else x * (1 + step)).astype(np.float32)
    finite, mask = np.isfinite(values), policy.targets.mask(shape)[None, :]
    touched, held = mask & finite, made
    if (policy.low, policy.high) != (None, None):
        held = np.where(np.isfinite(made), np.clip(made, policy.low, policy.high), made)
    clamped = int((touched & (held != made) & np.isfinite(made)).sum())
    new = np.where(touched, held, values)
    if shape.encoding is Encoding.BFLOAT16:
        new = bf16.decode(bf16.encode(new))
    bad, failure = touched & ~np.isfinite(new), None
    if bad.any():
        r, v = min(np.argwhere(bad).tolist(), key=lambda at: (pos[at[0]], at[1]))
        failure = NonFiniteResult(record=int(pos[r]), value=v, original=float(values[r, v]), perturbed=float(new[r, v]))
    return Noised(new, (int(touched.sum()), clamped, int((mask & ~finite).sum())), failure)


def fuzz(records: DataFrame, policy: Policy, shape: RecordShape, seed: int) -> DataFrame:
    """Noise on the targeted values. Values that are not finite stay as they are; a finite one that would stop
    being finite fails the job, whatever the bounds; `first_failure` names the first."""

    def change(values: np.ndarray, pos: np.ndarray) -> np.ndarray:
        out = noised(policy, shape, seed, values, pos)
        if out.failure:
            raise out.failure
        return out.values

    return map_values(records, change)


def _summed(records: DataFrame, schema: str, row: Callable[[np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """What row(values, pos) tells of each batch of records of one width."""
    names = [f.split()[0] for f in schema.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in row(values, batch.column(0).to_numpy())], arrow_schema(schema))

    return records.select("pos", "values").mapInArrow(batches, schema)


def counts(records: DataFrame, policy: Policy, shape: RecordShape, seed: int) -> DataFrame:
    """Targeted values by fate: perturbed (clamped ones too), clamped, preserved. A batch tells three numbers."""
    told = _summed(records, "perturbed bigint, clamped bigint, preserved bigint", lambda values, pos: [noised(policy, shape, seed, values, pos).counts])
    return told.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in told.columns])


def first_failure(records: DataFrame, policy: Policy, shape: RecordShape, seed: int) -> NonFiniteResult | None:
    """The first value, by record and index, that noise would make infinite: each batch tells its own first at most."""
    def row(values: np.ndarray, pos: np.ndarray) -> list[tuple]:
        found = noised(policy, shape, seed, values, pos).failure
        return [tuple(found.facts.values())] if found else []

    first = _summed(records, "record bigint, value int, original double, perturbed double", row).orderBy("record", "value").first()
    return NonFiniteResult(**first.asDict()) if first else None
