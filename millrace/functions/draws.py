"""Random draws as functions of a seed and a record's position, so any partitioning gives the same ones.

Records draw by md5, in the plan. Single values draw from a counter: two 32-bit words of a tag's md5 are mixed with
the position and the value's index, by multiplications that stay below 2^63, so SQL can follow them.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two multipliers of a public 32-bit mixing function.
MULTIPLIERS = (0x21F0AAAD, 0x735A2D97)
#: Adds to the key for the second lane of a draw.
LANE = 0x9E3779B9


def fresh_seed() -> int:
    return secrets.randbits(64)


def record_key(seed: int, tag: str, *by: Column | str) -> Column:
    """32 hex digits for each record."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in by]))


def record_uniform(seed: int, tag: str, *by: Column | str) -> Column:
    """A uniform draw in [0, 1) for each record, of 52 bits."""
    return F.conv(F.substring(record_key(seed, tag, *by), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def value_keys(seed: int, tag: str) -> tuple[int, int]:
    """The two words that the value draws of a seed and tag start from."""
    digest = hashlib.md5(f"{seed}:{tag}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def mix32(x: np.ndarray) -> np.ndarray:
    low = np.int64(0xFFFFFFFF)
    x = (x ^ (x >> 16)) * MULTIPLIERS[0] & low
    x = (x ^ (x >> 15)) * MULTIPLIERS[1] & low
    return x ^ (x >> 15)


def value_uniforms(keys: tuple[int, int], pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent uniforms in [0, 1), of 32 bits, for each of `n` values of each record: records x values."""
    record = mix32(mix32((pos & 0xFFFFFFFF) ^ keys[0]) ^ (pos >> 32 & 0xFFFFFFFF) ^ keys[1])[:, None]
    first = mix32(record ^ mix32(np.arange(n, dtype=np.int64) ^ keys[0])[None, :])
    return first / 2.0**32, mix32((first + LANE) & 0xFFFFFFFF) / 2.0**32

