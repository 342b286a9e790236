"""Pipelines: an ordered list of transforms, checked as a whole before anything is read."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..errors import EmptyPipeline, InvalidConfig, MillraceError, SourceEncodingMismatch, StageFailed, UnsupportedConfigVersion
from ..operators import fuzz as fuzzing
from ..operators import quantise as quantising
from ..operators import sample as sampling
from ..operators.records import one_file
from ..shape import Encoding, RecordShape

VERSION = 1
_WORD = (1 << 64) - 1
_KEYS = {
    "sample": ({"rate"}, {"seed"}),
    "fuzz": ({"distribution", "scale", "mode"}, {"targets", "clamp_min", "clamp_max", "seed"}),
    "quantise": ({"scheme"}, set()),
}


def stage_seed(seed: int, position: int) -> int:
    """The seed of the stage at `position`, from 1: output `position` of a SplitMix64 generator started at `seed`.

    Its three constants are that generator's, fixed values.
    """
    z = (seed + position * 0x9E3779B97F4A7C15) & _WORD
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = ((z ^ z >> shift) * factor) & _WORD
    return z ^ z >> 31


def stage_seeds(seed: int, positions: np.ndarray) -> np.ndarray:
    """`stage_seed` of many positions at once, as unsigned 64-bit integers."""
    z = np.uint64(seed & _WORD) + positions.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
    return z ^ z >> np.uint64(31)


@dataclass(frozen=True)
class Stage:
    """A planned stage: what it is called, its seed if it draws, its parameters and what it does to records."""

    position: int
    name: str
    seed: int | None
    parameters: dict
    apply: Callable[[DataFrame, RecordShape], DataFrame]
    #: The encodings that it reads, and what it makes of a shape.
    accepts: tuple[Encoding, ...] = tuple(Encoding)
    reshape: Callable[[RecordShape], RecordShape] = lambda shape: shape
    file_name: str = ""
    #: Of a stage that changes values alone: of an array of records of a shape, at their positions, the values as the
    #: stage's encoding holds them, how many were perturbed, clamped and preserved, and the first failure.
    change: Callable[[np.ndarray, np.ndarray, RecordShape], tuple] | None = None

    def record(self) -> dict:
        return {"name": self.name, "parameters": self.parameters} | ({"seed": self.seed} if self.seed is not None else {})


def _plan(name: str, spec: dict, position: int, seed: int) -> Stage:
    if name == "sample":
        rate = sampling.checked_rate(spec["rate"])
        return Stage(position, name, seed, {"rate": rate}, lambda df, _: sampling.sample(df, rate, seed), file_name=sampling.file_name(rate))
    if name == "fuzz":
        policy = fuzzing.Policy.named(spec["distribution"], spec["scale"], spec["mode"], spec.get("targets", "inputs"), spec.get("clamp_min"), spec.get("clamp_max"))

        def change(values: np.ndarray, pos: np.ndarray, shape: RecordShape) -> tuple:
            out = fuzzing.noised(policy, shape, seed, values, pos)
            return out.values, out.counts, out.failure

        return Stage(position, name, seed, policy.parameters(), lambda df, shape: fuzzing.fuzz(df, policy, shape, seed), file_name=policy.file_name, change=change)
    scheme = quantising.Scheme.named(spec["scheme"])
    return Stage(
        position, name, None, {"scheme": scheme.value}, lambda df, _: quantising.quantise(df, scheme), (Encoding.FLOAT32,),
        lambda shape: shape.encoded(scheme.encoding), scheme.file_name, lambda values, pos, shape: (quantising.rounded(values), (0, 0, 0), None),
    )


@dataclass(frozen=True)
class Pipeline:
    """Stages in order, as their specifications, and the seed that unpinned stages derive theirs from."""

    stages: tuple[dict, ...]
    seed: int | None = None

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        try:
            spec = json.loads(text)
        except ValueError as e:
            raise InvalidConfig(detail=str(e)) from e
        if not isinstance(spec, dict) or not isinstance(spec.get("stages"), list):
            raise InvalidConfig(detail="a configuration is an object with version and stages")
        if odd := set(spec) - {"version", "seed", "stages"}:
            raise InvalidConfig(detail=f"unknown keys: {sorted(odd)}")
        if spec.get("version") != VERSION:
            raise UnsupportedConfigVersion(found=spec.get("version"), expected=VERSION)
        made = cls(tuple(spec["stages"]), spec.get("seed"))
        made.plan(0)
        return made

    @classmethod
    def load(cls, path: str) -> Pipeline:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    def to_json(self) -> str:
        return json.dumps({"version": VERSION} | ({"seed": self.seed} if self.seed is not None else {}) | {"stages": list(self.stages)}, indent=2) + "\n"

    def plan(self, seed: int, encoding: Encoding = Encoding.FLOAT32) -> list[Stage]:
        """Every stage, checked: each has to read what the one before it writes, the first what the source holds.
        A pinned seed wins over the derived one."""
        if not self.stages:
            raise EmptyPipeline()
        planned, before = [], "the source"
        for position, spec in enumerate(self.stages, 1):
            name = spec.get("transform") if isinstance(spec, dict) else None
            if name not in _KEYS:
                raise InvalidConfig(detail=f"stage {position}: unknown transform {name!r}")
            needed, allowed = _KEYS[name]
            given = set(spec) - {"transform"}
            if odd := given - needed - allowed:
                raise InvalidConfig(detail=f"stage {position} ({name}): unknown keys: {sorted(odd)}")
            if gone := needed - given:
                raise InvalidConfig(detail=f"stage {position} ({name}): missing keys: {sorted(gone)}")
            own = spec.get("seed")
            try:
                stage = _plan(name, spec, position, stage_seed(seed, position) if own is None else own)
                if encoding not in stage.accepts:
                    raise SourceEncodingMismatch(manifest=before, expected=stage.accepts[0].value, found=encoding.value)
                planned.append(stage)
                encoding, before = stage.reshape(RecordShape(1, 1, encoding)).encoding, f"stage {position}"
            except MillraceError as e:
                raise StageFailed(position=position, name=name, cause=e) from e
        return planned

    def apply(self, records: DataFrame, shape: RecordShape, seed: int) -> tuple[DataFrame, RecordShape]:
        """The stages one after the other. Each draws by position in its own input, so any can be replayed alone."""
        for stage in self.plan(seed, shape.encoding):
            records, shape = one_file(stage.apply(records, shape), stage.file_name), stage.reshape(shape)
        return records, shape
