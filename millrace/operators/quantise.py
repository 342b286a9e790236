"""Quantisation: values at the precision of a smaller encoding, order and count unchanged."""

from __future__ import annotations

from collections.abc import Iterator
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownScheme
from ..functions import bf16
from ..shape import Encoding
from .records import map_values


#: What a batch adds to an error report.
PARTIAL = pa.schema([("n", pa.int64()), ("non_zero", pa.int64()), ("total", pa.float64()), ("relative", pa.float64()), ("absolute", pa.float64())])


class Scheme(Enum):
    BFLOAT16 = "bfloat16"

    @classmethod
    def named(cls, name: str) -> Scheme:
        try:
            return cls(name)
        except ValueError:
            raise UnknownScheme(scheme=name) from None

    @property
    def encoding(self) -> Encoding:
        return Encoding.BFLOAT16

    @property
    def max_relative_error(self) -> float:
        return 1 / 256

    @property
    def file_name(self) -> str:
        return f"quantise-{self.value}.bin"


def quantise(records: DataFrame, scheme: Scheme = Scheme.BFLOAT16) -> DataFrame:
    """Each value rounded to the scheme's precision, ties to even, by the codec that files are written with."""
    return map_values(records, lambda values, pos: rounded(values))


def rounded(values: np.ndarray) -> np.ndarray:
    return bf16.decode(bf16.encode(values))


def storage_reduction(source_bytes: int, output_bytes: int) -> float:
    return 1 - output_bytes / source_bytes if source_bytes else 0.0


def rounding_report(records: DataFrame, scheme: Scheme = Scheme.BFLOAT16) -> DataFrame:
    """The error report of quantising `records`, in one pass: each batch is summed up where it is read."""
    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                error, some = np.abs(rounded(x) - x), x != 0
                relative = (error[some] / np.abs(x[some])).astype("f8")
            row = {"n": len(x), "non_zero": len(relative), "total": float(relative.sum())}
            row |= {"relative": float(relative.max()) if len(relative) else None, "absolute": float(error.max()) if len(x) else None}
            yield pa.RecordBatch.from_pylist([row], PARTIAL)

    sums = records.select("values").mapInArrow(partial, "n bigint, non_zero bigint, total double, relative double, absolute double")
    zero = F.lit(0).cast("bigint")
    return sums.agg(
        F.coalesce(F.sum("n"), zero).alias("values"), F.coalesce(F.sum("non_zero"), zero).alias("non_zero"), F.max("relative").alias("max_relative"),
        F.try_divide(F.sum("total"), F.sum("non_zero")).alias("mean_relative"), F.max("absolute").alias("max_absolute"),
    )
