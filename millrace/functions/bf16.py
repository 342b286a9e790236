"""bfloat16: round-to-nearest-even as a column expression, and the bit codec that files are written and read with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column) -> Column:
    """`x` (float) at bfloat16 precision, ties to even; NaN, infinities and signed zeros stay what they are.

    Adding and taking away 1.5 * 2^(45 + exponent) in double leaves eight significant bits, rounded by the
    hardware; exponents stop at -126, below which bfloat16 has subnormals of one spacing.
    """
    size = F.abs(x.cast("double"))
    magic = F.lit(1.5) * F.pow(F.lit(2.0), F.lit(45.0) + F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-126.0)))
    near = F.when(x < 0, -((size + magic) - magic)).otherwise((size + magic) - magic)
    special = x.isNull() | F.isnan(x) | (size == float("inf")) | (x == 0)
    return F.when(special, x).otherwise(near.cast("float"))


def encode(values: np.ndarray) -> np.ndarray:
    """float32 to the 16 bits of bfloat16; a NaN stays one, with its quiet bit set."""
    bits = np.ascontiguousarray(values, np.float32).view(np.uint32)
    near = bits >> 16
    near &= 1
    near += 0x7FFF
    near += bits  # wraps only for NaN
    near >>= 16
    nan = np.isnan(values)
    if nan.any():
        near[nan] = (bits[nan] >> 16) | 0x40
    return near.astype(np.uint16)


def decode(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint32) << 16).view(np.float32)
