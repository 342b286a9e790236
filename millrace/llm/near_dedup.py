"""Near-duplicate detection by an inverted join over MinHash coordinates.

A document's shingle set gives COORDINATES minima. Every (coordinate, value) pair is a posting list; documents as
similar as the threshold asks collide on far more than MATCHES coordinates. Two that collide on that many must
share COMMON of the first COORDINATES - MATCHES + COMMON of their pairs in any common order, so only this prefix is
posted, and a document that shares fewer with anyone is done; the order is by list length, so lists that very many
documents share through a common passage are skipped unless the documents are alike in nearly everything.
Candidates that collide on MATCHES coordinates are confirmed on their full shingle sets.

Identical sets fold into one representative first. Each representative is then compared with the member that is
central to most of its lists, which joins nearly all of a group of copies without any pairs among them. A pair
inside one component needs no further link, so only lists whose members lie in different components go on:

* a short list gives its pairs;
* in a longer one every member is compared with a leader. What two members share beyond what the leader tells is
  in how they deviate from it (shingles that they lack or add), and two that are alike, but not both like the
  leader, must share deviations; how many at least follows from their sizes. So members are posted again, under
  (leader, deviation) for a prefix of their rarest deviations, and those lists are treated in the same way. As the
  prefix is the shorter the less the partner is like the leader, members go by classes of likeness, with a
  prefix for each class that a partner may be in.

A list's children lack its leader, so the rounds end; no linked pair is missed, and members of a large family that
all differ share no rare deviations and are never paired.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, relabelled
from .kernels import U64, mixed, runs, shingle_hashes, string_bytes, word_hashes
from .shared import compact, hot_keys, numbered, spread_join, written

#: Bytes of texts whose shingles are made at once: their arrays stay in a processor's cache.
AT_ONCE = 1 << 18
COORDINATES = 64
#: At similarity 0.8 a pair collides on 51 of 64 coordinates, give or take 3; on fewer than 34 about once in 10^7.
MATCHES = 34
#: How many pairs of the posted prefix two such documents share at least; each adds one to the prefix, and the more
#: are asked for, the more documents without a partner are sorted out at once.
COMMON = 10
#: Counters of list lengths: a consistent order is all they give, so lists may share one.
BUCKETS = 1 << 18
#: Counters of deviations, and counters that a task tells as one row.
APART, SLICE = 1 << 22, 1 << 14
#: Packs that a batch of postings of deviations is dealt in.
SLICES = 1 << 10
#: Members of a list of signatures, and of one of deviations, that is short enough to give its pairs.
SHORT, SHORT_APART = 4, 64
#: Upper edges of the classes of members by their weight, in units of the greatest weight that is linked to the leader.
EDGES = (-0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0)
LINKED = EDGES.index(1.0)
_CLASS = np.random.default_rng(911).integers(0, 1 << 64, (len(EDGES) + 1, len(EDGES) + 1), dtype=U64)
#: Place of a signature's posting: its lists don't bound what two documents share.
ANY = 1 << 40
#: Side of a posting whose partners are all others of its list; those of sides 0 and 1 are each other's.
BOTH = 2

_rng = np.random.default_rng(4_093)
_MUL = _rng.integers(0, 1 << 64, COORDINATES, dtype=U64) | U64(1)
_ADD = _rng.integers(0, 1 << 64, COORDINATES, dtype=U64)


def run_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each run of documents in turn: the sorted distinct hashes of the shingles of each, end to end, and their number."""
    for _, _, data, offsets in runs(column, AT_ONCE):
        words, _, _, counts = word_hashes(data, offsets)
        shingles, n = shingle_hashes(words, counts, size)
        ends, doc = np.cumsum(n), np.repeat(np.arange(len(n)), n)
        for start, end in zip(ends - n, ends, strict=True):
            shingles[start:end].sort()
        first = np.ones(len(shingles), bool)
        first[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
        yield shingles[first], np.bincount(doc[first], minlength=len(n))


def document_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each document in turn, the sorted distinct hashes of its shingles."""
    for own, n in run_sets(column, size):
        ends = np.cumsum(n)
        for start, end in zip(ends - n, ends, strict=True):
            yield own[start:end]


def minima(distinct: np.ndarray) -> np.ndarray:
    """The signature: 32 bits of each coordinate's minimum."""
    low = np.full(COORDINATES, 2**64 - 1, U64)
    for i in range(0, len(distinct), 2048):
        np.minimum(low, (distinct[i : i + 2048, None] * _MUL + _ADD).min(axis=0), out=low)
    return (mixed(low + _ADD) >> U64(32)).astype(np.uint32)


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, h1, h2, sig): the set's size, 128 bits that identify it and its minima; none for an empty set."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, h1, h2, sig = [], [], [], []
            for own in document_sets(batch.column(1), size):
                n.append(len(own))
                h1.append(set_hash(own))
                h2.append(int(np.bitwise_xor.reduce(mixed(own + _MUL[0])).view(np.int64)) if len(own) else 0)
                sig.append(minima(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())],
                names=["id", "n_shingles", "h1", "h2", "sig"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary")


def set_hash(own: np.ndarray) -> int:
    return int(mixed(own).sum(dtype=U64).view(np.int64))


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the `wanted` (node, doc, h1): the sorted distinct 64-bit shingle hashes, as bytes, of each
    node's text, which is one of those named by `doc`. Rows that repeat an id and its text give repeated rows."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = list(document_sets(batch.column(1), size))
            right = [set_hash(s) == h for s, h in zip(own, batch.column(2).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in own], pa.binary())], names=["id", "shingles"])
            yield out.filter(pa.array(right, pa.bool_()))

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.join(wanted.hint("shuffle_hash"), "doc").select("node", "text", "h1").mapInArrow(batches, "id bigint, shingles binary")


SET = ["n_shingles", "h1", "h2"]


def unlike_sets(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The sets among the written `rows` (id, n_shingles, h1, h2, ...): (id, doc, n, set, *columns), where the set is the
    node and `id` its number, as an id may name several texts, and `doc` the least id that has it; and the links (a, b)
    between sets that share an id, or None if no id repeats."""
    named = rows.where("id IS NOT NULL AND n_shingles > 0")
    folded = named.groupBy(*SET).agg(F.min("id").alias("doc"), *[F.any_value(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n"))
    folded = written(folded.withColumn("id", F.monotonically_increasing_id()), "folded")
    several = named.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if several.isEmpty():
        return folded, None
    several = written(several, "several")
    mine = spread_join(named.select("id", *SET), several, "id", "h1", hot_keys(several.select("id", F.col("rows").alias("n")), ["id"], named.count()))
    mine = mine.distinct().withColumnRenamed("id", "name").join(folded.select(*SET, F.col("id").alias("b")), SET)
    mine = written(mine.select("name", "b"), "names")
    least = mine.groupBy("name").agg(F.min("b").alias("a"))
    return folded, spread_join(mine, least, "name", "b").where("a != b").select("a", "b").distinct()


def by_row(rows: DataFrame, folded: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, n_shingles, component_id) of every row, from the labels (node, component) of sets: the least id of all
    that have a set in the component."""
    placed = written(folded.join(labels.withColumnRenamed("node", "id"), "id", "left").select(*SET, "doc", F.coalesce("component", "id").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    groups = spread_join(placed, least, "component", "doc").select(*SET, "component_id")
    named = rows.where("id IS NOT NULL AND n_shingles > 0").select("id", *SET)
    out = spread_join(named, groups, SET, "id", hot_keys(folded.select(*SET, "n"), SET, rows.count()))
    alone = rows.where("id IS NULL OR n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.select("id", "n_shingles", "component_id").unionByName(alone)


def _signature_rows(column: pa.Array) -> np.ndarray:
    return string_bytes(column)[0].view(np.uint32).reshape(-1, COORDINATES)


def _shingle_rows(column: pa.Array) -> np.ndarray:
    return string_bytes(column)[0].view(U64)


def _slice(packed: pa.BinaryScalar) -> np.ndarray:
    data = packed.as_buffer()
    return np.frombuffer(data, f"u{len(data) // SLICE}")


def histogram(rows: DataFrame, buckets, size: int = BUCKETS) -> np.ndarray:
    """How many values of the one column fall into each of `size` counters: as many numbers, whatever the corpus.

    Tasks tell all their counters, in slices of which each is a row of the smallest integers that hold it, and slices are
    summed by their place: as many rows a task whatever its values are, and no counter is left out.
    """

    def told(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        packed = [part.astype(np.min_scalar_type(int(part.max()))).tobytes() for part in counts.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(packed, pa.binary())], names=["slice", "counts"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in it:
            for part in buckets(batch.column(0)):
                np.add.at(total, part, np.uint32(1))  # an int of Python's is added in another, far slower way
        yield told({at: part for at, part in enumerate(total.reshape(-1, SLICE)) if part.any()})

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = defaultdict(lambda: np.zeros(SLICE, np.int64))
        for batch in it:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[at] += _slice(part)
        yield told(total)

    schema = "slice bigint, counts binary"
    found = written(rows.mapInArrow(batches, schema).repartition("slice").mapInArrow(sums, schema), "counters").toArrow()
    lengths = np.zeros((size // SLICE, SLICE), np.int64)
    for at, part in zip(found["slice"].to_pylist(), found["counts"], strict=True):
        lengths[at] = _slice(part)
    return lengths.ravel()


def ranks(lengths: np.ndarray) -> np.ndarray:
    """Counters for an order alone, in two bytes."""
    return np.minimum(lengths, 2**16 - 1).astype(np.uint16)


def list_lengths(reps: DataFrame) -> np.ndarray:
    """Documents per counter of (coordinate, value) pairs."""
    return histogram(reps.select("sig"), lambda column: [(_signature_rows(column) % BUCKETS).ravel()])


def prefix_postings(reps: DataFrame, lengths: np.ndarray, matches: int) -> DataFrame:
    """(token, id, n_shingles, score): each document under the pairs of its prefix that others may share.

    `score` is the summed length of the document's lists; the highest in a list is its most central member.
    """
    prefix = COORDINATES - matches + COMMON

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in it:
            sig = _signature_rows(batch.column(2))
            if not len(sig):
                continue
            length = lengths[sig % BUCKETS]
            tokens = places | sig.astype(np.int64)
            order = np.lexsort((tokens, length))[:, :prefix]
            chosen = np.take_along_axis(length, order, 1) > 1
            row = np.repeat(np.arange(len(sig)), chosen.sum(1))
            columns = [np.take_along_axis(tokens, order, 1)[chosen], batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], length.sum(1)[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "id", "n_shingles", "score"])

    return reps.select("id", "n_shingles", "sig").mapInArrow(batches, "token bigint, id bigint, n_shingles bigint, score bigint")


def beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The written `pairs` (a, b) with the `column` of both in `table` (id, column). Many pairs may have one a."""
    left, right = (table.select(F.col("id").alias(x), F.col(column).alias(f"{column}_{x}")) for x in "ab")
    return spread_join(pairs.select("a", "b"), left, "a", "b").join(right, "b").select("a", "b", f"{column}_a", f"{column}_b")


def colliding(pairs: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) that collide on at least `matches` coordinates."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hits = (_signature_rows(batch.column(2)) == _signature_rows(batch.column(3))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hits >= matches))

    return beside(pairs, reps, "sig").mapInArrow(batches, "a bigint, b bigint")


def among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the distinct sorted x are in the distinct sorted y."""
    if not len(y):
        return np.zeros(len(x), bool)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x


def alike(x: int, y: int, common: int, percent: int) -> bool:
    """Whether sets of x and y elements with so many in common are linked."""
    return common > 0 and 100 * common >= percent * (x + y - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = sorted((np.frombuffer(v.as_buffer(), U64) for v in (x, y)), key=len)
                near = 100 * len(x) >= percent * len(y)  # the intersection is no larger than the smaller set
                keep.append(near and alike(len(x), len(y), int(among(x, y).sum()), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return beside(pairs, sets, "shingles").mapInArrow(batches, "a bigint, b bigint")


def least_partner(lacks: int, adds: int, lead: int, percent: int) -> int:
    """The weight that a member has at least which is linked to one that lacks so many of a leader's `lead` shingles
    and adds so many, as far as these numbers tell.

    With l and d for lacks and adds, a weight is 200 * l + 2 * percent * d - (100 - percent) * lead. The two share
    l' + d' at most, and no more of either kind than the first one has, so 2 * percent * l' + 200 * d' has to come up
    to `gap`; that costs the least weight where d' is as large as can be.
    """
    own = 2 * percent
    gap = 200 * lacks + own * adds - 2 * (100 - percent) * lead
    if gap <= 200 * adds:
        return own * max(gap, 0) // 200 - (100 - percent) * lead
    return 200 * (gap - 200 * adds) // max(own, 1) + own * adds - (100 - percent) * lead


def deviations(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, weight, class, least, shingles) of leaders a and members b: the shingles that only one of the two has, each
    hashed with the leader, the member's part of what a pair under that leader has to share, and the least weight of
    the members that it can be linked to.

    With L, n shingles of leader and member and m of the leader's that the member lacks, two members have
    L - m - m' + c in common, c being the deviations they share. They are linked if (100 + percent) times that is
    percent * (n + n') at least, that is, if 2 * (100 + percent) * c >= weight + weight'. The leader's own weight is
    -(100 - percent) * L, so the members linked to it are those of weight (100 - percent) * L and less.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            weight, kind, least, apart = [], [], [], []
            for lead, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = among(x, y)
                lacks = x[~both]
                weight.append(2 * percent * len(y) + 2 * (100 + percent) * len(lacks) - (100 + percent) * len(x))
                unit = max(1, (100 - percent) * len(x))
                kind.append(sum(weight[-1] > e * unit for e in EDGES))
                adds = y[~among(y, x)]
                least.append(least_partner(len(lacks), len(adds), len(x), percent))
                apart.append(mixed(np.concatenate([lacks, adds]) ^ mixed(np.array([lead]).astype(U64))).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(weight, pa.int64()), pa.array(kind, pa.int32()), pa.array(least, pa.int64()), pa.array(apart, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "weight", "class", "least", "shingles"])

    return beside(pairs, sets, "shingles").mapInArrow(batches, "a bigint, b bigint, weight bigint, class int, least bigint, shingles binary")


def in_slices(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of 64-bit integers, of which the first column is a hash, packed by SLICES slices of that hash."""
    values = np.stack(columns, 1)
    of = (values[:, 0].view(U64) % U64(SLICES)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    at, first = np.unique(of[order], return_index=True)
    packed = [part.tobytes() for part in np.split(values[order], first[1:])] if len(at) else []
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed, pa.binary())], names=["slice", "packed"])


def starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def partnered(own: np.ndarray, scale: int) -> np.ndarray:
    """Which of the postings (key, id, component, weight, rest, side), in order of their keys, may have a partner: there
    is one on the other side of the list, in another component, whose weight asks for no more than `rest`."""
    key, _, component, weight, rest, side = own.T
    first = starts(key)
    n, out = np.diff(first, append=len(own)), np.zeros(len(own), bool)
    if not len(own):
        return out
    for mine, other in ((0, 1), (1, 0), (BOTH, BOTH)):
        partner = side == other
        told = ((np.minimum, weight, ANY), (np.minimum, component, 2**63 - 1), (np.maximum, component, -(2**63)))
        lightest, low, high = (np.repeat(f.reduceat(np.where(partner, c, none), first), n) for f, c, none in told)
        out |= (side == mine) & ((low < component) | (high > component)) & (rest * scale >= weight + lightest)
    return out


def deviation_lists(members: DataFrame, percent: int, labels: DataFrame | None = None) -> DataFrame:
    """(key, id, component, weight, rest, side, n, lead), as of `open_lists`: the written `deviations` posted under those
    of them by which a partner in another component of the written `labels` can be found; `rest` is how many the two can
    share at most from this one on. Without labels every member is a component of its own.

    The least weight in a partner's class, or that a partner of the member has at least, bounds from below what the two
    have to share: a prefix argument, made for each class under that leader apart, with the classes of both in the key.
    A list for two classes has a side for each, and members of one side find nothing by it among themselves. Two linked
    members need no link, and a deviation that is alone on its counter has no partner, nor has a member in a class that
    lies in its own component or is too light for it. However full the counters are, postings meet by their keys, in
    packs, and only those that may have a partner become rows.
    """
    lengths = ranks(histogram(members.select("shingles"), lambda column: [(_shingle_rows(column) % U64(APART)).astype(np.int64)], APART))
    placed = members.withColumn("component", F.col("b"))
    if labels is not None:
        placed = members.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    classes = placed.groupBy("a", "class").agg(
        F.min("weight").alias("low"), F.max("weight").alias("high"), (F.max(F.length("shingles")) / 8).cast("bigint").alias("most"), F.min("component").alias("first"), F.max("component").alias("last")
    )
    classes = classes.groupBy("a").agg(F.collect_list(F.struct("class", "low", "high", "most", "first", "last")).alias("classes"))
    scale = 2 * (100 + percent)
    hot = hot_keys(members.groupBy("a").agg(F.count(F.lit(1)).alias("n")), ["a"], members.count())
    told = spread_join(placed, classes.where(F.exists("classes", lambda c: c["class"] > LINKED)), "a", "b", hot)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = [[np.zeros(0, np.int64)] for _ in range(6)]
            for id_, component, weight, kind, least, classes, blob in zip(*[batch.column(k).to_pylist() for k in range(6)], batch.column(6), strict=True):
                own = np.frombuffer(blob.as_buffer(), U64)
                length = lengths[own % U64(APART)]
                order = np.lexsort((own, length))
                own, alone = own[order], int((length < 2).sum())
                for other in classes:
                    need = max(1, -(-(weight + max(other["low"], least)) // scale))
                    across = not other["first"] == other["last"] == component and other["high"] >= least
                    if across and max(kind, other["class"]) > LINKED and need <= min(len(own), other["most"]):
                        at = np.arange(alone, len(own) - need + 1)
                        key = mixed(own[at] ^ _CLASS[min(kind, other["class"]), max(kind, other["class"])]).view(np.int64)
                        side = BOTH if kind == other["class"] else int(kind > other["class"])
                        for column, values in zip(columns, (key, *[np.full(len(at), v) for v in (id_, component, weight)], len(own) - at, np.full(len(at), side)), strict=True):
                            column.append(values)
            yield in_slices([np.concatenate(c) for c in columns])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [np.frombuffer(v.as_buffer(), np.int64) for batch in it for v in batch.column(1)]
        if packs:
            own = np.concatenate(packs).reshape(-1, 6)
            own = own[np.lexsort((own[:, 1], own[:, 3], own[:, 0]))]  # the least weight leads a list
            while not (may := partnered(own, scale)).all():  # who has lost all partners is none
                own = own[may]
            first = starts(own[:, 0])
            n = np.diff(first, append=len(own))
            columns = [*own.T, np.repeat(n, n), np.repeat(own[first, 1], n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "component", "weight", "rest", "side", "n", "lead"])

    packed = told.select("b", "component", "weight", "class", "least", "classes", "shingles").mapInArrow(batches, "slice bigint, packed binary")
    return packed.repartition("slice").mapInArrow(meet, "key bigint, id bigint, component bigint, weight bigint, rest bigint, side bigint, n bigint, lead bigint")


def open_lists(lists: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """The written lists (key, id, ...) whose members lie in different components, with component, lead and n, the
    member of least weight and the number of members; without the documents that are in fewer than `least` such lists."""
    placed = lists.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = written(placed, "placed")
    heads = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("weight", "id")).alias("head"))
    heads = written(heads.where("low < high").select("key", "n", F.col("head.id").alias("lead")), "heads")
    members = spread_join(placed, heads, "key", "id", hot_keys(heads.select("key", "n"), ["key"], placed.count()))
    members = written(members, "members")
    if least == 1:
        return members
    # of k lists a document and its partner share `least`, so they share one of the first k - least + 1, the longest first
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "key"))
    k = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return written(members.withColumn("place", place).withColumn("k", k).where(F.col("place") <= F.col("k") - least + 1).drop("place", "k"), "members")


def across_components(lists: DataFrame, labels: DataFrame, sets_of, percent: int, test, least: int, most: int) -> DataFrame:
    """The components (node, component) once every linked pair in a list of the written `lists` (key, id, weight, rest)
    counts. `sets_of` has the sets (id, shingles) of pairs, `test` tells linked pairs (a, b) from others; two linked documents share `least` lists or more, and lists
    of at most `most` members give their pairs."""
    scale = 2 * (100 + percent)
    members = open_lists(lists, labels, least).withColumn("side", F.lit(BOTH))
    while not members.isEmpty():
        short = members.where(F.col("n") <= most).select("key", "id", "component", "weight", "rest", "side")
        x, y = (short.select("key", *[F.col(c).alias(f"{c}_{i}") for c in short.columns if c != "key"]) for i in "ab")
        may = (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b"))
        may &= (F.col("side_a") != F.col("side_b")) | (F.col("side_a") == BOTH)
        may &= F.least("rest_a", "rest_b") * scale >= F.when(F.col("rest_a") < ANY, F.col("weight_a") + F.col("weight_b")).otherwise(0)
        pairs = written(x.join(y, "key").where(may).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "pairs")
        found = test(pairs)
        led = members.where((F.col("n") > most) & (F.col("id") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
        led = written(led, "led")
        if led.isEmpty():
            fresh = written(found, "links")
            return labels if fresh.isEmpty() else relabelled(labels, fresh)
        apart = written(deviations(led, sets_of(led), percent), "deviations")
        fresh = written(found.unionByName(apart.where(F.col("class") <= LINKED).select("a", "b")), "links")
        if not fresh.isEmpty():
            labels = relabelled(labels, fresh)
        members, most = written(deviation_lists(apart, percent, labels), "members"), SHORT_APART
    return labels


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept.

    Words are runs outside space and 0x09-0x0D, lower-cased in A-Z; a document's set is its distinct shingles of
    `size` words, or the whole sequence if it has fewer. Documents are linked when 100 * intersection >= percent *
    union, and component_id is the smallest id reachable over links. Null, empty and blank texts have no set and
    link with nothing; rows without an id stay alone, component_id null and kept true. Rows that
    repeat an id are one node with the links of all their texts; kept says only whether the id is the
    component's. Texts of any length count whole. An empty table gives no rows. Other columns of `docs` are not read.
    """
    signed = written(signatures(docs, size, id_col, text_col), "signed")
    reps, same = unlike_sets(signed, ["sig"])
    postings = prefix_postings(reps, list_lengths(reps), matches)
    top = F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("top")
    lists = written(postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"), top).where("n > 1").select("token", "n", (-F.col("top.minus")).alias("leader")), "lists")
    hot = hot_keys(lists.select("token", "n"), ["token"], lists.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    shared = written(spread_join(postings.select("token", "id", "score"), lists.select("token", "leader"), "token", "id", hot), "postings")
    shared = written(shared.join(shared.groupBy("id").count().where(F.col("count") >= COMMON).select("id"), "id", "left_semi"), "shared")
    wanted = reps.join(shared.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("node"), "doc", "h1")
    sets = shingle_sets(docs, wanted, size, id_col, text_col)
    sets = written(sets if same is None else sets.dropDuplicates(["id"]), "sets")

    def test(pairs: DataFrame) -> DataFrame:
        return confirmed(written(compact(colliding(pairs, reps, matches), pairs.count()), "tested"), sets, percent)

    votes = shared.where("leader != id").groupBy("id", "leader").count()
    best = votes.groupBy(F.col("id").alias("b")).agg(F.max(F.struct("count", "leader")).alias("best")).select(F.col("best.leader").alias("a"), "b")
    links = test(written(best, "best"))
    links = written(links if same is None else links.unionByName(same), "confirmed")
    lists = shared.select(F.col("token").alias("key"), "id", (-F.col("score")).alias("weight"), F.lit(ANY).alias("rest"))
    labels = across_components(lists, components(links), lambda _: sets, percent, test, COMMON, SHORT)
    out = by_row(signed, reps, labels)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component, that of the smallest id, nulls last; all its columns kept.

    Rows are grouped one by one, so identifiers may repeat or be missing; texts without words all stay.
    """
    rows, row = numbered(docs)
    groups = written(near_groups(rows.select(row, text_col), size, percent, MATCHES, row, text_col).select(F.col(row).alias("at"), "component_id"), "groups")
    several = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = spread_join(groups, several, "component_id", "at", hot_keys(several, ["component_id"], groups.count()))
    members = written(rows.select(F.col(id_col).alias("id"), F.col(row).alias("at")).join(members, "at"), "members")
    stay = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("keep")).select(F.col("keep.at").alias("at"))
    gone = members.select("at").join(stay, "at", "left_anti").withColumnRenamed("at", row)
    return rows.join(gone, row, "left_anti").select(*docs.columns)
