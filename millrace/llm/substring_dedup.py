"""Removal of repeated substrings by a partitioned, sampled suffix array.

A byte is removed if a string of LENGTH bytes over it also starts in a document with a smaller id. Sorting every
suffix of a corpus moves LENGTH bytes per byte, so suffixes are sampled by content: of each window of LENGTH bytes
the smallest-hashing LEAD-byte string is its anchor, the leftmost of equals. Windows with equal bytes have equal
anchors at equal places, so nothing is lost by comparing only windows of equal anchors, a block at a time:

1. blocks, fingerprinted, are range-partitioned by sampled splitters and sorted. A block that a smaller document
   has too is covered whole; one whose anchor occurs in no other block is dropped; the rest are ragged edges.
2. edges fetch their bytes. Their suffixes are range-partitioned by the leading bytes, again by sampled splitters;
   a bucket sorts its windows by multikey quicksort, eight bytes at a time, ids last, and compares neighbours.
   Equal leading bytes share a bucket, so no comparison crosses a boundary. Anchors with very many edges have
   their windows dealt by all their bytes instead, with minima before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .kernels import U64, mixed, powers, runs
from .shared import written

LENGTH, LEAD = 50, 16
#: Bytes of a document that are read for anchors at once, and bits for a place among them.
SEGMENT, PLACE_BITS = 1 << 22, 24
#: Edges of one anchor that a single bucket compares; windows that a bucket sorts at once.
HOT, SORTED = 50_000, 200_000
_PLACES = U64((1 << PLACE_BITS) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, lead: int = LEAD) -> tuple[np.ndarray, ...]:
    """Blocks of a run of documents: anchor hash, block hash, document, first window's place in the run, number of
    windows, and the anchor's distance from the first window. Every window of `length` bytes is in one block."""
    span, n = length - lead + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(U64), none.view(U64), none, none, none, none
    p, p_inv = powers(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(kernels._BYTE[data] * p, out=total[1:])
    leads = mixed((total[lead:] - total[:-lead]) * p_inv[: n - lead + 1])
    low = (leads & ~_PLACES) | np.arange(len(leads), dtype=U64)
    step = 1
    while 2 * step <= span:
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    if span > step:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
    at = (low & _PLACES).astype(np.int64)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    whole = np.arange(len(at)) + length <= offsets[1:][doc]
    first = whole.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~whole[:-1] | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(first)
    last = whole.copy()
    last[:-1] &= first[1:] | ~whole[1:]
    n_windows = np.flatnonzero(last) + 1 - lo
    rel = at[lo] - lo
    block = mixed((total[lo + n_windows + length - 1] - total[lo]) * p_inv[lo] + (rel * 64 + n_windows).astype(U64))
    return leads[at[lo]], block, doc[lo], lo, n_windows, rel


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, bytes of the document before) of runs; a very long document comes in segments
    that share length - 1 bytes, so each window is in one."""
    for first, _, data, offsets in runs(column):
        for start in range(0, max(1, len(data) - LENGTH + 1), SEGMENT) if len(offsets) == 2 else (0,):
            part = data[start : start + SEGMENT + LENGTH - 1] if len(offsets) == 2 else data
            yield first, part, np.array([0, len(part)]) if len(offsets) == 2 else offsets, start


def block_rows(rows: DataFrame) -> DataFrame:
    """(anchor, block, doc, at) over rows (doc, text, tag); `at` packs place, tag, windows and distance."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, tags = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for first, data, offsets, before in pieces(batch.column(1)):
                lead, block, doc, lo, n, rel = anchors(data, offsets)
                at = (((lo - offsets[doc] + before) << 16 | tags[first + doc]) << 6 | n) << 6 | rel
                columns = [lead.view(np.int64), block.view(np.int64), ids[first + doc], at]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "block", "doc", "at"])

    return rows.select("doc", "text", "tag").mapInArrow(batches, "anchor bigint, block bigint, doc bigint, at bigint")


def settle(blocks: DataFrame, n: int) -> DataFrame:
    """(edge, anchor, doc, at): blocks that are covered whole, and edges that their windows must settle.

    Rows of a task come by anchor, block and document. In a run of one block, rows after the smallest document's
    are covered. That document's stay as edges if the anchor has another block, or if the anchor's rows touch the
    task's first or last, as they may go on in the neighbour's.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["edge", "anchor", "doc", "at"]

        def out(edge: bool, anchor, doc, at) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), edge)), *[pa.array(x, pa.int64()) for x in (anchor, doc, at)]], names=names)

        held = None  # of the anchor that the last batch ended in: the anchor, its last block, that run's first document, whether shared, waiting rows
        for batch in it:
            anchor, block, doc, at = (batch.column(k).to_numpy() for k in range(4))
            if not len(anchor):
                continue
            new_anchor = np.concatenate([[held is None or anchor[0] != held[0]], anchor[1:] != anchor[:-1]])
            new_block = new_anchor | np.concatenate([[held is None or block[0] != held[1]], block[1:] != block[:-1]])
            starts = np.flatnonzero(new_block)
            run = np.cumsum(new_block)
            low = np.concatenate([[held[2] if held else 0], doc[starts]])[run]
            covered = doc > low
            yield out(False, anchor[covered], doc[covered], at[covered])
            group = np.cumsum(new_anchor)  # 0: goes on from the last batch
            n_blocks = np.bincount(group, new_block, group[-1] + 1)
            shared = n_blocks > 1
            if held is not None:
                if group[0] == 0:
                    shared[0] = held[3] or n_blocks[0] > 0
                    if shared[0] and len(held[4][0]):
                        yield out(True, *held[4])
                elif held[3] and len(held[4][0]):
                    yield out(True, *held[4])
            else:
                shared[1 if len(shared) > 1 else 0] = True  # the task's first anchor
            final = group == group[-1]
            stay = ~covered & shared[group]
            yield out(True, anchor[stay], doc[stay], at[stay])
            wait = ~covered & final & ~shared[group]
            waiting = (anchor[wait], doc[wait], at[wait])
            if held is not None and group[-1] == 0 and not shared[0]:
                waiting = tuple(np.concatenate(x) for x in zip(held[4], waiting, strict=True))
            held = (anchor[-1], block[-1], low[-1], bool(shared[group[-1]]), waiting)
        if held is not None and len(held[4][0]):
            yield out(True, *held[4])

    dealt = blocks.repartitionByRange(n, "anchor", "block", "doc").sortWithinPartitions("anchor", "block", "doc")
    return dealt.mapInArrow(batches, "edge boolean, anchor bigint, doc bigint, at bigint")


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, tag, windows, distance"""
    return at >> 28, (at >> 12) & 0xFFFF, (at >> 6) & 63, at & 63


def edge_bytes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(lead0, lead1, hot, doc, at, bytes): the edges with the bytes of their windows and, to sort by, their anchors'."""
    per_doc = edges.groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "hot")).alias("edges"))
    joined = rows.join(per_doc.hint("shuffle_hash"), ["doc", "tag"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                at, hot = (own.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                place, _, n, rel = unpacked(at)
                found = [raw[p : p + m + LENGTH - 1] for p, m in zip(place.tolist(), n.tolist(), strict=True)]
                lead = np.frombuffer(b"".join(f[r : r + LEAD] for f, r in zip(found, rel.tolist(), strict=True)), ">i8").reshape(-1, 2)
                columns = [pa.array(lead[:, 0].astype(np.int64)), pa.array(lead[:, 1].astype(np.int64)), pa.array(hot), pa.array(np.full(len(at), doc)), pa.array(at), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["lead0", "lead1", "hot", "doc", "at", "bytes"])

    kinds = "lead0 bigint, lead1 bigint, hot boolean, doc bigint, at bigint, bytes binary"
    return joined.select("doc", "text", "edges").mapInArrow(batches, kinds)


def multikey_order(keys: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of words (rows x words) by word after word and then by `last`, and where a new row value starts.

    Each round sorts by one word the groups that are still tied on all before; rows alone in their group are done.
    """
    order = np.arange(len(keys))
    group = np.zeros(len(keys), np.int64)
    open_rows = np.arange(len(keys))
    for k in range(keys.shape[1]):
        word = keys[order[open_rows], k]
        by = np.lexsort((word, group[open_rows]))
        order[open_rows] = order[open_rows][by]
        word, own = word[by], group[open_rows]
        split = np.concatenate([[True], (own[1:] != own[:-1]) | (word[1:] != word[:-1])])
        group[open_rows] = open_rows[np.flatnonzero(split)][np.cumsum(split) - 1]
        tied = np.zeros(len(open_rows), bool)
        tied[1:] = ~split[1:]
        tied[:-1] |= ~split[1:]
        open_rows = open_rows[tied]
        if not len(open_rows):
            break
    order = order[np.lexsort((last[order], group))]
    return order, np.concatenate([[True], group[1:] != group[:-1]])[: len(order)]


def compare(docs: np.ndarray, places: np.ndarray, n: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(edge, place) of each window of the edges that a smaller document has too."""
    edge = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    begin = (np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1))[edge] + nth
    width = -(-LENGTH // 8) * 8
    windows = np.zeros((len(edge), width), np.uint8)
    windows[:, :LENGTH] = raw[begin[:, None] + np.arange(LENGTH)]
    order, new = multikey_order(windows.view(">u8").astype(U64), docs[edge])
    low = docs[edge][order][np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = order[docs[edge][order] > low]
    return edge[hit], places[edge[hit]] + nth[hit]


def covered_windows(edges: DataFrame, n: int) -> DataFrame:
    """(doc, tag, start, end): byte spans of the edges' windows that a smaller document has too."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        docs, at = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        place, tag, windows, _ = unpacked(at)
        edge, start = compare(docs, place, windows, [r[2] for r in rows])
        columns = [docs[edge], tag[edge], start, start + LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "tag", "start", "end"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, key = [], 0, None
        for batch in it:
            for lead, doc, at, blob in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), *[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True):
                if size >= SORTED and lead != key:
                    yield spans(rows)
                    rows, size = [], 0
                rows.append((doc, at, blob))
                size, key = size + ((at >> 6) & 63), lead
        if rows:
            yield spans(rows)

    few = edges.where("NOT hot").repartitionByRange(n, "lead0", "lead1").sortWithinPartitions("lead0", "lead1")
    kinds = "doc bigint, tag bigint, start bigint, end bigint"
    few = few.select("lead0", "lead1", "doc", "at", "bytes").mapInArrow(batches, kinds)
    many = edges.where("hot").select("doc", "at", "bytes", F.explode(F.expr("sequence(0, cast(((at >> 6) & 63) - 1 as int))")).alias("nth"))
    many = many.select("doc", F.expr("(at >> 12) & 65535").alias("tag"), F.expr("(at >> 28) + nth").alias("start"), F.expr(f"substring(bytes, nth + 1, {LENGTH})").alias("window"))
    lowest = many.groupBy("window").agg(F.min("doc").alias("low"))
    many = many.join(lowest, "window").where("doc > low").select("doc", "tag", "start", (F.col("start") + LENGTH).alias("end"))
    return few.unionByName(many)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tag, start, end): byte spans, which may overlap, whose every window starts in a smaller document too.

    `tag` is 16 bits of the text's hash and tells apart rows that share an id.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = tagged(docs, id_col, text_col).where("doc IS NOT NULL").select("doc", "text", "tag")
    settled = written(settle(block_rows(rows), n), "settled")
    edges = settled.where("edge").withColumn("tag", F.expr("(at >> 12) & 65535"))
    hot = edges.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    edges = edges.join(hot, "anchor", "left").select("doc", "tag", "at", F.coalesce("hot", F.lit(False)).alias("hot"))
    blocks = written(edge_bytes(rows, edges), "edges")
    windows = covered_windows(blocks, n)
    whole = settled.where("NOT edge").select("doc", F.expr("(at >> 12) & 65535").alias("tag"), F.expr("at >> 28").alias("start"), F.expr(f"(at >> 28) + ((at >> 6) & 63) + {LENGTH - 1}").alias("end"))
    return written(whole.unionByName(windows).distinct(), "spans")


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("tag", F.xxhash64("text").bitwiseAND(0xFFFF))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay).

    Null text is empty. Rows that share an id are compared with smaller ids only; rows without an id lose nothing
    and take nothing. Texts under LENGTH bytes lose nothing. An empty table gives no rows. Other columns are not
    read.
    """
    spans = repeated_spans(docs, id_col, text_col).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = tagged(docs, id_col, text_col).join(spans.hint("shuffle_hash"), ["doc", "tag"], "left")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            size, removed, n_spans, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                size.append(len(raw))
                if not spans.is_valid:
                    removed.append(0)
                    n_spans.append(0)
                    kept.append(raw)
                    continue
                start, end = (spans.values.field(k).to_numpy() for k in (0, 1))
                depth = np.bincount(start, minlength=len(raw) + 1) - np.bincount(end, minlength=len(raw) + 1)
                gone = np.cumsum(depth)[:-1] > 0
                removed.append(int(gone.sum()))
                n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (size, removed, n_spans)], pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.select("doc", "text", "spans").mapInArrow(batches, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", id_col)
