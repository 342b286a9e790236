"""Value transforms on a stream: quantising and noise look at one record alone, so they need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.fuzz import Policy, fuzz
from ..operators.quantise import Scheme, quantise
from ..shape import RECORDS, RecordShape


def record_stream(spark: SparkSession, directory: str) -> DataFrame:
    """Records from Parquet files as they come."""
    return spark.readStream.schema(RECORDS).parquet(directory)


def transformed(stream: DataFrame, shape: RecordShape, policy: Policy | None = None, seed: int = 0, scheme: Scheme | None = None) -> DataFrame:
    """Noise, then quantisation, as asked for; the same values that a batch over the same positions gives."""
    if policy is not None:
        stream = fuzz(stream, policy, shape, seed)
    return quantise(stream, scheme) if scheme is not None else stream
