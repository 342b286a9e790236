"""Benchmark decontamination: SimHash of item-sized windows, multi-index look-up, exact verification.

Every benchmark item of n words is compared with windows of n words; a document of fewer words is one window, the
whole of it, where it has shingles enough to be as similar as asked. A window can only be as similar as asked if
enough of its shingles occur in items of its size, so windows without are left out before any fingerprint is made:
they cannot match. The others get a 128-bit SimHash over their shingles, each counted as often as it occurs. The
index cuts fingerprints into 8 blocks of 16 bits and lists every item under all values within a bit of its own
block: two fingerprints within 15 bits agree within one bit on some block, so none within that radius is missed, and
a window meets about one in five hundred of the items of its size by chance.

A window at similarity 0.8 may lie outside any radius that is still selective, so there is an exact way beside the
index: of an item's shingles the window lacks fewer than a fifth, so it has one of any fifth of them. The rarest
fifth among the items are the item's anchors, and a window meets the items whose anchors it holds. What either way
finds is verified on the words themselves by weighted Jaccard similarity, the sum of the smaller shingle counts over
the sum of the larger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mixed, runs, shingle_hashes, word_hashes
from .shared import numbered, spread_join, written

SHINGLE, BLOCKS, BLOCK_BITS, FLIPS = 5, 8, 16, 1
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Words of items whose shingles go to every task at once, 8 bytes each; a larger benchmark takes a pass over the
#: documents per so many.
WORDS_PER_PASS = 4_000_000
#: Pairs of texts whose similarity a task remembers: speed only, as a passage that many documents share recurs.
REMEMBERED = 64
#: Shingles whose running bit sums are held at once, and the mixing constants of the two fingerprint halves.
SPAN = 4096
_HALVES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], U64)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash halves, (len(starts), 2), of the windows of `length` shingles that begin at sorted `starts`."""
    out = np.empty((len(starts), 2), U64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + SPAN, "left"))
        part = shingles[starts[i] : starts[j - 1] + length]
        halves = mixed(part[:, None] ^ _HALVES)
        bits = np.unpackbits(halves.view(np.uint8).reshape(len(part), 16), axis=1)
        total = np.zeros((len(part) + 1, 128), np.int32)
        np.cumsum(bits, axis=0, out=total[1:])
        at = starts[i:j] - starts[i]
        ones = total[at + length] - total[at]
        out[i:j] = np.packbits(2 * ones > length, axis=1).view(U64)
        i = j
    return out


def anchors(shingles: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """Of the shingles of an item, and how often each occurs in all items: distinct ones, the rarest first, that make
    up one more occurrence than a window may lack."""
    own, at, n = np.unique(shingles, return_index=True, return_counts=True)
    order = np.lexsort((own, often[at]))
    spare = len(shingles) - -(-percent * len(shingles) // 100) + 1
    return own[order][: int(np.searchsorted(np.cumsum(n[order]), spare)) + 1]


class Index:
    """Of a block of items: the shingle hashes and the anchors by size in words, and (text, anchor) of every item's
    anchors. Its size follows the items given to it."""

    def __init__(self, texts: list[str], percent: int):
        self.percent, self.by_size, self.anchors, self.anchored = percent, {}, {}, []
        row = 0
        for _, _, data, offsets in runs(pa.array(texts, pa.large_string())):
            words, _, _, counts = word_hashes(data, offsets)
            shingles, n = shingle_hashes(words, counts, SHINGLE)
            owner = np.repeat(counts, n)
            for size in np.unique(counts[counts > 0]).tolist():
                self.by_size.setdefault(size, []).append(shingles[owner == size])
            self.anchored.append((row, shingles, n, counts))
            row += len(counts)
        every = np.concatenate([x[1] for x in self.anchored] or [np.zeros(0, U64)])
        every, often = np.unique(every, return_counts=True)
        told = []
        for first, shingles, n, counts in self.anchored:
            for k, (m, end, size) in enumerate(zip(n.tolist(), np.cumsum(n).tolist(), counts.tolist(), strict=True)):
                if size >= SHINGLE:
                    own = anchors(shingles[end - m : end], often[np.searchsorted(every, shingles[end - m : end])], percent)
                    self.anchors.setdefault(size, []).append(own)
                    told += [(texts[first + k], a) for a in own.view(np.int64).tolist()]
        self.anchored, self.anchors = told, {k: np.unique(np.concatenate(v)) for k, v in self.anchors.items()}
        self.by_size = {k: np.unique(np.concatenate(v)) for k, v in self.by_size.items()}
        self.any = np.unique(np.concatenate([v for k, v in self.by_size.items() if k >= SHINGLE] or [np.zeros(0, U64)]))

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[list[int]]]]:
        """(size, starts, fingerprints, anchors held) of the windows of one document that may match an item."""
        count = np.array([len(words)])
        own, _ = shingle_hashes(words, count, SHINGLE)
        found = contained(own, self.any) if len(words) >= SHINGLE else np.zeros(0, bool)
        hit = np.flatnonzero(found)
        for size, known in self.by_size.items():
            if size > len(words) and (len(words) < SHINGLE or 100 * len(own) < self.percent * (size - SHINGLE + 1)):
                continue
            if size < SHINGLE:
                short, _ = shingle_hashes(words, count, size)
                starts, base, length = np.flatnonzero(contained(short, known)), short, 1
                met = np.zeros(0, np.int64)  # equal windows have equal fingerprints
            else:
                length, base = min(size - SHINGLE + 1, len(own)), own
                need = -(-self.percent * (size - SHINGLE + 1) // 100)
                if len(hit) < need:
                    continue
                total = np.zeros(len(own) + 1, np.int32)
                total[hit[contained(own[hit], known)] + 1] = 1
                total = np.cumsum(total)
                starts = np.flatnonzero(total[length:] - total[: len(total) - length] >= need)
                met = hit[contained(own[hit], self.anchors[size])]
            if len(starts):
                low, high = np.searchsorted(met, starts), np.searchsorted(met, starts + length)
                held = [np.unique(base[met[a:b]]).view(np.int64).tolist() for a, b in zip(low, high, strict=True)]
                yield size, starts, fingerprints(base, starts, length), held


def contained(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def window_rows(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    """(id, start, size, f1, f2, window, anchors): windows that may match items of `size` words, with their text and
    the anchors of such items that they hold."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, out = batch.column(0).to_pylist(), [[] for _ in range(7)]
            for first, _, data, offsets in runs(batch.column(1)):
                words, begins, ends, counts = word_hashes(data, offsets)
                shingles, n = shingle_hashes(words, counts, SHINGLE)
                owner = np.repeat(np.arange(len(counts)), n)
                few = np.zeros(len(counts), bool)
                few[owner[contained(shingles, index.any)]] = True
                if any(size < SHINGLE for size in index.by_size):
                    few[:] = True
                upto = np.concatenate([[0], np.cumsum(counts)])
                for d in np.flatnonzero(few):
                    a, b = upto[d], upto[d + 1]
                    for size, starts, prints, held in index.windows(words[a:b]):
                        for s, (f1, f2), own in zip(starts.tolist(), prints.view(np.int64).tolist(), held, strict=True):
                            text = data[begins[a + s] : ends[min(a + s + size, b) - 1]].tobytes().decode()
                            for column, value in zip(out, (ids[first + d], s, size, f1, f2, text, own), strict=True):
                                column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "start", "size", "f1", "f2", "window", "anchors"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "id bigint, start bigint, size bigint, f1 bigint, f2 bigint, window string, anchors array<bigint>")


def item_prints(items: DataFrame) -> DataFrame:
    """(item_id, size, g1, g2, item): the items' fingerprints."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size, prints = [], []
            for _, _, data, offsets in runs(batch.column(1)):
                words, _, _, counts = word_hashes(data, offsets)
                shingles, n = shingle_hashes(words, counts, SHINGLE)
                for c, m, end in zip(counts.tolist(), n.tolist(), np.cumsum(n).tolist(), strict=True):
                    size.append(c)
                    prints.append(fingerprints(shingles[end - m : end], np.zeros(1, np.int64), m).view(np.int64)[0].tolist() if m else [0, 0])
            halves = [pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *halves, batch.column(1)], names=["item_id", "size", "g1", "g2", "item"])

    return items.mapInArrow(batches, "item_id bigint, size bigint, g1 bigint, g2 bigint, item string").where("size > 0")


def blocks(f1: str, f2: str):
    """The blocks of a fingerprint as one array of integers, the block's number above its bits."""
    per_half = BLOCKS // 2
    cut = lambda c, k: F.shiftrightunsigned(F.col(c), BLOCK_BITS * k).bitwiseAND((1 << BLOCK_BITS) - 1)
    return F.array(*[(cut(f1 if k < per_half else f2, k % per_half) + F.lit(k << BLOCK_BITS)).cast("int") for k in range(BLOCKS)])


def within_radius(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(size, f1, f2, item_id): fingerprints of windows and items of one size that differ in RADIUS bits at most."""
    flips = [sum(1 << b for b in c) for k in range(FLIPS + 1) for c in combinations(range(BLOCK_BITS), k)]
    listed = items.select("item_id", "size", "g1", "g2", F.explode(blocks("g1", "g2")).alias("own"))
    listed = listed.select("item_id", "size", "g1", "g2", F.explode(F.array(*map(F.lit, flips))).alias("flip"), "own")
    listed = listed.select("item_id", "size", "g1", "g2", F.col("own").bitwiseXOR(F.col("flip")).alias("block"))
    asked = prints.select("size", "f1", "f2", F.explode(blocks("f1", "f2")).alias("block"))
    apart = F.bit_count(F.col("f1").bitwiseXOR(F.col("g1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("g2")))
    return asked.hint("merge").join(listed, ["size", "block"]).where(apart <= RADIUS).select("size", "f1", "f2", "item_id").distinct()


def by_anchor(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(size, f1, f2, item_id): fingerprints of windows with the items of their size whose anchors they hold."""
    asked = windows.select("size", "f1", "f2", F.explode("anchors").alias("anchor")).distinct()
    return asked.join(items, ["size", "anchor"]).select("size", "f1", "f2", "item_id").distinct()


@lru_cache(REMEMBERED)
def weighted_similarity(a: str, b: str) -> float:
    """Sum of the smaller over sum of the larger counts of the texts' shingles, words lower-cased in A-Z."""
    bags = []
    for text in (a, b):
        words = text.encode().lower().split()
        bags.append(Counter(tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))))
    common = (bags[0] & bags[1]).total()
    return common / (bags[0].total() + bags[1].total() - common)


def verified(candidates: DataFrame, percent: int) -> DataFrame:
    """(id, item_id, start, size, similarity) of candidates (…, window, item) that are similar enough; size is the
    window's words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            score = [weighted_similarity(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            size = pa.array([len(w.encode().split()) for w in batch.column(4).to_pylist()], pa.int64())
            out = pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], size, pa.array(score, pa.float64())], names=["id", "item_id", "start", "size", "similarity"])
            yield out.filter(pa.array([100 * s >= percent for s in score], pa.bool_()))

    return candidates.select("id", "item_id", "start", "size", "window", "item").mapInArrow(batches, "id bigint, item_id bigint, start bigint, size bigint, similarity double")


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item with a similar window: id, item_id, similarity (the best), start_word, n_words, n_windows.

    Words are runs outside space and 0x09-0x0D, lower-cased in A-Z; shingles have five words, or all of a shorter
    item's. A document of fewer words than the item is one window. Of equally similar windows the first is given. Null or wordless texts and items match nothing; items
    with one text each match; texts of any length count whole; rows that repeat an id report together, those without an id under null. Empty tables
    give no rows. Only ids and texts are read.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    listed = written(item_prints(items), "items")
    passes = max(1, -(-(listed.agg(F.sum("size").alias("n")).first()["n"] or 0) // WORDS_PER_PASS))
    found = None
    for k in range(passes):
        part = listed.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(passes)) == k)
        index = Index([r.item for r in part.select("item").distinct().collect()], percent)
        windows = written(window_rows(docs, index, id_col, text_col), "windows")
        held = docs.sparkSession.createDataFrame(pa.table({"item": pa.array([t for t, _ in index.anchored], pa.string()), "anchor": pa.array([a for _, a in index.anchored], pa.int64())}))
        pairs = within_radius(windows.select("size", "f1", "f2").distinct(), part).unionByName(by_anchor(windows, part.select("item_id", "size", "item").join(held, "item")))
        pairs = pairs.distinct().join(part.select("item_id", "item", "size"), ["item_id", "size"])
        hits = verified(spread_join(windows.drop("anchors"), pairs, ["size", "f1", "f2"], "id"), percent)
        found = hits if found is None else found.unionByName(hits)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("minus"), "size")).alias("best")
    return found.groupBy("id", "item_id").agg(best, F.count(F.lit(1)).alias("n_windows")).select(
        F.col("id").alias(id_col), "item_id", "best.similarity", (-F.col("best.minus")).alias("start_word"), F.col("best.size").alias("n_words"), "n_windows"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that hold a benchmark item, all columns kept. Each row is judged by its own text,
    whatever other rows have the same id or none; `id_col` is not read."""
    rows, row = numbered(docs)
    bad = contamination(rows.select(row, text_col), benchmark, percent, row, text_col).select(row).distinct()
    return rows.join(bad, row, "left_anti").select(*docs.columns)
