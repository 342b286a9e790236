"""Similarity self-join on word n-grams by Jaccard, exact: tiles of a size band, hashed bitmaps, sorted arrays.

A document's set is the sorted array of its distinct shingles' hashes. Two sets of x and y elements are linked if
they share at least need(x, y) of them, so in any one order of all shingles their first common one is among the first
x - need + 1 of one and the first y - need + 1 of the other. The order is by counters of how often shingles occur, rarest
first, so a passage that very many documents share comes last and posts nobody but its own copies.

* Equal sets fold into one representative.
* Each representative is posted under the shingles of its prefix, in the tile of its size band and in that of the
  band below, in which partners down to `percent` of its size lie. A tile is a shingle in a band: its members are all
  that may be linked through that shingle, and sizes and places bound what two of them can share.
* Each member is first compared with the member central to most of its tiles, which joins nearly all of a family
  without any pairs among it; tiles whose members then lie in one component are done, and of the rest only pairs of
  unlike components go on (`near_dedup.across_components`, which needs no bound on a tile's members).
* A pair is first met by its bitmaps: a set's elements flip bits of 2 * size bits or more, as many in both bands of a
  tile, so the bits in which two bitmaps differ are at most the elements that only one of the sets has, and the bound
  on the overlap that follows drops nearly all pairs that are not linked at a 32nd of the bytes. What is left is
  intersected exactly; only for that are sets made of texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .kernels import U64, mixed, runs, shingle_hashes, word_hashes
from .near_dedup import AT_ONCE, across_components, beside, by_row, confirmed, histogram, ranks, run_sets, shingle_sets, unlike_sets
from .shared import written

#: Counters of occurrences: a consistent order is all they give, so shingles may share one.
COUNTERS = 1 << 22
_ALSO = np.random.default_rng(1_117).integers(0, 1 << 64, 2, dtype=U64)
#: Bits of the least bitmap; each band's is a power of two above.
LEAST_BITS = 64
#: Members of a tile that is small enough to give its pairs.
TILE = 32
#: Bands that a mask tells apart.
MASK = 62


def need(x: int | np.ndarray, y: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Elements that linked sets of x and y elements share at least."""
    return -(-percent * (x + y) // (100 + percent))


def band(n: np.ndarray, percent: int) -> np.ndarray:
    """The size band of n: linked sets are of one band or of two that follow each other."""
    edges = [1]
    while edges[-1] <= (int(n.max()) if len(n) else 0):
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent))
    return np.searchsorted(edges, n, "right") - 1


def bits(n: int) -> int:
    """Width of the bitmap of a set of n elements: a power of two, twice its size at least."""
    return max(LEAST_BITS, 1 << (2 * n - 1).bit_length())


def bitmap(own: np.ndarray, width: int) -> np.ndarray:
    """`width` bits, as bytes: each is whether an odd number of the set's elements fall on it. Folding one half onto
    the other with exclusive or gives the bitmap of half the width."""
    return flipped(mixed(own ^ _ALSO[1]), width)


def flipped(at: np.ndarray, width: int) -> np.ndarray:
    out = np.bincount((at % U64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(out.astype(np.uint8), bitorder="little")


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the wider one folded to the other's width."""
    x, y = sorted((np.frombuffer(v, np.uint8) for v in (x, y)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def occurrences(docs: DataFrame, size: int, text_col: str) -> np.ndarray:
    """How many shingles fall on each of COUNTERS counters, as far as `ranks` tells."""

    def buckets(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in runs(column, AT_ONCE):
            words, _, _, counts = word_hashes(data, offsets)
            yield (shingle_hashes(words, counts, size)[0] % U64(COUNTERS)).astype(np.int64)

    return ranks(histogram(docs.select(F.col(text_col).cast("string")), buckets, COUNTERS))


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums mod 2^64 of consecutive parts of `values` of these sizes, as signed integers."""
    out, some = np.zeros(len(sizes), U64), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out.view(np.int64)


def measured(docs: DataFrame, counts: np.ndarray, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, h1, h2, band, prefix, bitmap): the set's size, 128 bits that identify it, its size band, the
    shingles that it is posted under, rarest first, and its bitmap; none of these two for an empty set."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, h1, h2, prefix, bitmaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
            for hashes, sizes in run_sets(batch.column(1), size):
                n.append(sizes)
                h1.append(sums(mixed(hashes), sizes))
                h2.append(sums(mixed(hashes ^ _ALSO[0]), sizes))
                rank, places = counts[hashes % U64(COUNTERS)], mixed(hashes ^ _ALSO[1])
                ends = np.cumsum(sizes)
                for start, end, m in zip((ends - sizes).tolist(), ends.tolist(), sizes.tolist(), strict=True):
                    order = np.argsort(rank[start:end], kind="stable")[: m - -(-percent * m // 100) + 1]
                    prefix.append(hashes[start:end][order].tobytes() if m else None)
                    bitmaps.append(flipped(places[start:end], bits(m)).tobytes() if m else None)
            n, h1, h2 = (np.concatenate(x) for x in (n, h1, h2))
            numbers = [pa.array(x, pa.int64()) for x in (n, h1, h2, band(n, percent))]
            columns = [batch.column(0), *numbers, pa.array(prefix, pa.binary()), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "h1", "h2", "band", "prefix", "bitmap"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "id bigint, n_shingles bigint, h1 bigint, h2 bigint, band bigint, prefix binary, bitmap binary")


def postings(reps: DataFrame, percent: int) -> DataFrame:
    """(token, id, at, core): each set of `reps` (id, n_shingles, prefix) under the shingles of its prefix, the place of
    each there, and whether a set that is no smaller can still be linked through that shingle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = batch.column(1).to_numpy()
            sizes = np.array([len(v.as_buffer()) // 8 for v in batch.column(2)], np.int64)
            token = np.frombuffer(b"".join(v.as_buffer() for v in batch.column(2)), np.int64)
            row = np.repeat(np.arange(len(n)), sizes)
            at = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            columns = [token, batch.column(0).to_numpy()[row], at, n[row] - at >= need(n, n, percent)[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "id", "at", "core"])

    return reps.select("id", "n_shingles", "prefix").mapInArrow(batches, "token bigint, id bigint, at int, core boolean")


def met(posted: DataFrame) -> DataFrame:
    """(token, id, at, lead): the postings under shingles that may link two sets, each with the set that the fewest
    rarer shingles put before this one, the most central there. One exchange of postings, most of which stand alone; a
    shingle has a row a set that is posted under it, a small part of any set's rows, and is read as it comes."""
    own = Window.partitionBy("token")
    told = posted.select("token", "id", "at", F.count(F.lit(1)).over(own).alias("n"), F.max("core").over(own).alias("core"), F.min(F.struct("at", "id")).over(own).alias("lead"))
    return told.where("n > 1 AND core").select("token", "id", "at", F.col("lead.id").alias("lead"))


def still_open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (token, id, at) of `shared` under shingles whose sets lie in different components."""
    own, component = Window.partitionBy("token"), F.coalesce("component", "id")
    placed = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "at", component.alias("component"))
    apart_ = F.min("component").over(own) < F.max("component").over(own)
    return placed.withColumn("apart", apart_).where("apart").select("token", "id", "at")


def bit(of: str) -> Column:
    """A long with one bit, which bands that lie MASK apart share: a tile too many then, never one too few."""
    return F.expr(f"shiftleft(1L, cast(pmod({of}, {MASK}) as int))")


def tiles(shared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(key, id, weight, rest) for `across_components`: each posting in the tile of its shingle and band, and, as the
    larger one, in that of the band below where that tile has members of its own; `rest` is what the set has from that
    shingle on, which bounds what it can share through it."""
    rows = shared.join(sizes.select("id", "n_shingles", "band"), "id").withColumn("bands", F.bit_or(bit("band")).over(Window.partitionBy("token")))
    each = F.explode(F.when(F.col("bands").bitwiseAND(bit("band - 1")) != 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("low", each)
    return rows.select(F.xxhash64("token", F.col("band") - F.col("low")).alias("key"), "id", (F.col("n_shingles") * 2 * percent).alias("weight"), (F.col("n_shingles") - F.col("at")).alias("rest"))


def bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that may share as much as they need to, as far as their bitmaps tell."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, y = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            differ = np.array([apart(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column("bitmap_a"), batch.column("bitmap_b"), strict=True)], np.int64)
            may = np.minimum((x + y - differ) // 2, np.minimum(x, y)) >= need(x, y, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(may))

    told = reps.select("id", F.struct(F.col("n_shingles").alias("n"), "bitmap").alias("own"))
    both = beside(pairs, told, "own").select("a", "b", *[F.col(f"own_{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("n", "bitmap")])
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return both.where(near).mapInArrow(batches, "a bigint, b bigint")


def join_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id.

    Words are runs outside space and 0x09-0x0D, lower-cased in A-Z; a document's set is its distinct shingles of
    `size` words, or the whole sequence if it has fewer. Documents are linked when 100 * intersection >= percent *
    union, on sets of 64-bit hashes; every link between unlike texts counts, and component_id is the smallest id
    reachable over links. Null, empty and blank texts have no set and link with nothing; texts of any length count
    whole. Rows that repeat an id are one node, with the links of all their texts. A row without an id links with
    nothing, component_id null. An empty table gives no rows; other columns of `docs` are not read.
    """
    rows = measured(docs, occurrences(docs, size, text_col), size, percent, id_col, text_col)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "measured")
    nodes, same = unlike_sets(rows, ["row"])
    numbers = nodes.select("row", F.col("id").alias("node"))
    first = lambda *c: rows.select("row", *c).join(numbers, "row").select(F.col("node").alias("id"), *c)
    shared = written(met(postings(first("n_shingles", "prefix"), percent)), "shared")
    reps = written(first("n_shingles", "band", "bitmap").join(shared.select("id").distinct(), "id", "left_semi"), "bitmaps")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets of the written `pairs`, from the texts: only what bitmaps or long tiles ask for is ever made."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = nodes.join(ids, "id", "left_semi").select(F.col("id").alias("node"), "doc", "h1")
        sets = shingle_sets(docs, wanted, size, id_col, text_col)
        return written(sets if same is None else sets.dropDuplicates(["id"]), "sets")

    def test(pairs: DataFrame) -> DataFrame:
        may = written(bounded(pairs, reps, percent), "bounded")
        return may if may.isEmpty() else confirmed(may, sets_of(may), percent)

    votes = shared.where("lead != id").groupBy("id", "lead").count()
    best = votes.groupBy(F.col("id").alias("b")).agg(F.max_by("lead", F.struct("count", "lead")).alias("a")).select("a", "b")
    links = test(written(best, "best"))
    links = written(links if same is None else links.unionByName(same), "links")
    labels = components(links)
    lists = written(tiles(written(still_open(shared, labels), "open"), reps, percent), "tiles")
    labels = across_components(lists, labels, sets_of, percent, test, 1, TILE)
    return by_row(rows, nodes, labels).select(F.col("id").alias(id_col), "n_shingles", "component_id")
