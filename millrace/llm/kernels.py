"""Array kernels over Arrow string columns: bytes, words and shingles of many documents at once.

Each works on whole texts. Batches are cut into runs of documents of at most RUN_BYTES (a longer document is a
run of its own), so memory follows the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 21
U64 = np.uint64

_rng = np.random.default_rng(20_240_229)
#: A random odd multiplier with its inverse mod 2^64, a random word per byte value, and multipliers by place.
_B = int(_rng.integers(1 << 62, dtype=np.int64)) * 2 + 1
_B_INV = pow(_B, -1, 1 << 64)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=U64)
PLACE = _rng.integers(0, 1 << 64, 64, dtype=U64) | U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i mod 2^64 for i < n; kept for the next call unless very long."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_B, _B_INV):
        p = np.full(n, base, U64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 4 * RUN_BYTES:
        _powers[:] = made
    return made[0], made[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive runs of documents of at most `size` bytes."""
    data, offsets = string_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, in order: its hash after lower-casing A-Z, first byte, end byte; and words per document.

    Words are the maximal runs outside space and 0x09-0x0D; a document's end also ends a word.
    """
    n = len(data)
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    low = LOWER[data]
    inside = ~SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    p, p_inv = powers(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[low] * p, out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * p_inv[starts] + (ends - starts).astype(U64))
    return hashes, starts, ends, np.diff(np.searchsorted(starts, offsets))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` words at each start, and shingles per document.

    A document with fewer words, but some, has one shingle: the whole sequence.
    """
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + first[doc]
    out = np.zeros(len(doc), U64)
    if len(doc):
        room, last = (first + counts)[doc], len(words) - 1
        for k in range(size):
            here = at + k
            out += np.where(here < room, words[np.minimum(here, last)] * PLACE[k], U64(0))
        out = mixed(out + np.minimum(counts[doc], size).astype(U64))
    return out, n
