"""Sampling: each record is kept by its own draw, and each file's kept records are shuffled as a block."""

from __future__ import annotations

import hashlib
import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRate
from ..functions.draws import record_key, record_uniform
from .records import replaced


def checked_rate(rate: float) -> float:
    if not (rate > 0.0 and rate <= 1.0):
        raise InvalidRate(rate=rate)
    return float(rate)


def percent(rate: float) -> int:
    """The rate as a whole percentage, halves away from zero."""
    return int(Decimal(rate * 100).quantize(Decimal(1), ROUND_HALF_UP))


def file_name(rate: float) -> str:
    return f"sample-{percent(rate)}.bin"


def file_name_of(rate: str) -> Column:
    """`file_name` of a column of rates."""
    return F.concat(F.lit("sample-"), F.round(F.col(rate) * 100).cast("int").cast("string"), F.lit(".bin"))


def expected_bytes(source_bytes: int, bytes_per_record: int, rate: float) -> int:
    """What a sample of a source needs: whole expected records, rounded up, and a hundredth more, rounded up."""
    records = source_bytes // bytes_per_record
    size = min(max(0, math.ceil(records * rate)), records) * bytes_per_record
    return size + -(-size // 100)


def kept(records: DataFrame, rate: float, seed: int) -> DataFrame:
    """The records whose own draw is under the rate: a filter on position alone, which the scan can apply first."""
    return records.where(record_uniform(seed, "keep", "pos") < checked_rate(rate))


def sample(records: DataFrame, rate: float, seed: int) -> DataFrame:
    """A sample at `rate`: files in shuffled order, each file's kept records shuffled within it, positions anew."""
    return replaced(kept(records, rate, seed), record_key(seed, "file", "file_ord"), record_key(seed, "order", "pos"))


def file_order(seed: int, files: int) -> list[int]:
    """The files of a source in the order in which a sample has them, by the key that `sample` gives each."""
    return sorted(range(files), key=lambda k: (hashlib.md5(f"{seed}:file:{k}".encode()).hexdigest(), k))


def share_by_file(records: DataFrame, rate: float, seed: int) -> DataFrame:
    """Records read and kept per file."""
    hit = F.when(record_uniform(seed, "keep", "pos") < checked_rate(rate), 1)
    return records.groupBy("file_ord").agg(F.count(F.lit(1)).alias("records_read"), F.count(hit).alias("records_kept"))
