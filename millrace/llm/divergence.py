"""Audit of how sources diverge: integer-coded term counts of each source against the other sources of its language.

Texts are coded batch by batch: terms become integers of a dictionary, counts are bincounts over those integers. The
terms that a language keeps are range-partitioned in UTF-8 order and cut into chunks of CHUNK. A chunk has its own
sorted array of kept terms, searchsorted gives each counted term its id in it, and a bincount of ids per source gives
one dense vector per source. Ids keep the order of terms, so the first of equal values is the least term. Vectors of
SOURCES sources at most meet in a task, so a language may have any number of terms and sources, and no task holds
all of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, runs, string_bytes
from .shared import written

#: Documents of its language that a kept term is in, ranks of terms that are told, and the scale of shares.
LEAST, TOP, SCALE = 10, 10, 1_000_000_000
#: Kept terms of a chunk, and sources whose vectors meet in a task.
CHUNK, SOURCES = 4_096, 64
#: Rows of counts in a chunk, and tasks that a language's chunks are dealt over.
ROWS, DEALT = 1 << 20, 64
#: Bytes of text that are coded by one dictionary.
CODED = 1 << 24
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of texts end to end, A-Z lower-cased and coded as integers, and the text that each is in."""
    inside = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(LOWER[data[inside]]))
    return found.dictionary_encode(), np.searchsorted(offsets, starts, "right") - 1


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed up within runs of texts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            group = pa.StructArray.from_arrays([batch.column(1), batch.column(2)], names=["lang", "source"])
            codes, names = _codes(group)
            for first, end, data, offsets in runs(batch.column(0), CODED):
                coded, doc = terms(data, offsets)
                size = max(1, len(coded.dictionary))
                pair, n = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
                cell, of = np.unique(codes[first:end][pair // size] * size + pair % size, return_inverse=True)
                total = np.zeros(len(cell), np.int64)
                np.add.at(total, of, n)
                at = pa.array(cell // size)
                columns = [names.field(0).take(at), names.field(1).take(at), coded.dictionary.take(pa.array(cell % size)).cast(pa.string()), pa.array(total), pa.array(np.bincount(of, minlength=len(cell)))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    rows = docs.select("text", "lang", "source").mapInArrow(batches, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _codes(group: pa.StructArray) -> tuple[np.ndarray, pa.StructArray]:
    """Integers for the (lang, source) of each row, and what they stand for."""
    parts = [group.field(k).dictionary_encode() for k in range(2)]
    size = max(1, len(parts[1].dictionary))
    used, codes = np.unique(parts[0].indices.to_numpy().astype(np.int64) * size + parts[1].indices.to_numpy(), return_inverse=True)
    names = [parts[0].dictionary.take(pa.array(used // size)), parts[1].dictionary.take(pa.array(used % size))]
    return codes, pa.StructArray.from_arrays(names, names=["lang", "source"])


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for totals below 2^52: a long division by thousands."""
    whole = total + 2 * kept
    out, rest = (counts + 2) // whole, (counts + 2) % whole
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return 1 + out


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); the square is at most 10^18."""
    return (p - q) ** 2 // (p + q)


def kept_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n) of the terms in at least LEAST documents of their language."""
    rows = written(counted(docs), "counts")
    in_docs = F.sum("docs").over(Window.partitionBy("lang", "term"))  # a row for each source at most
    return written(rows.withColumn("in_docs", in_docs).where(F.col("in_docs") >= LEAST).select("lang", "term", "source", "n"), "kept")


def totals(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, sources, sums, kept_terms): each language's sources in order, their counts of kept terms, and how many
    terms it keeps."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    told = groups.join(sums, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("one"))
    told = told.groupBy("lang").agg(F.sort_array(F.collect_list("one")).alias("all"))
    terms_ = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept_terms"))
    return told.join(terms_, "lang").select("lang", F.col("all.source").alias("sources"), F.col("all.n").alias("sums"), "kept_terms")


def _cuts(rows: pa.RecordBatch, final: bool) -> list[int]:
    """Ends of the chunks at the head of rows sorted by (lang, term): at most CHUNK terms of one language each, in
    at most ROWS rows unless one term has more. Without `final` the last one waits for the rows that follow."""
    lang, term = rows.column("lang"), rows.column("term")
    other = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
    fresh = np.concatenate([[0], np.flatnonzero(other | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)) + 1])
    speaks = np.concatenate([[0], np.cumsum(other)])[fresh]
    ends, k = [], 0
    while k < len(fresh):
        most = min(k + CHUNK, int(np.searchsorted(speaks, speaks[k], "right")), max(k + 1, int(np.searchsorted(fresh, fresh[k] + ROWS))))
        ends.append(int(fresh[most]) if most < len(fresh) else rows.num_rows)
        k = most
    return ends if final else ends[:-1]


_CHUNK = "lang string, terms array<string>, ids array<int>, sources array<string>, counts array<bigint>"


def chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows (lang, term, source, n) sorted by (lang, term): the sorted kept terms, and the rows by id."""
    listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)

    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        term = rows.column("term").cast(pa.binary())
        kept = term.unique()  # in order, as the rows are
        place = np.searchsorted(kept.to_numpy(zero_copy_only=False), term.to_numpy(zero_copy_only=False)).astype(np.int32)
        columns = [rows.column("lang")[:1], *(listed(c) for c in (kept.cast(pa.string()), pa.array(place), rows.column("source"), rows.column("n")))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "terms", "ids", "sources", "counts"])

    held = None
    for batch in it:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        start = 0
        for end in _cuts(held, False) if held.num_rows else []:
            yield made(held.slice(start, end - start))
            start = end
        held = held.slice(start)
    start = 0
    for end in _cuts(held, True) if held is not None and held.num_rows else []:
        yield made(held.slice(start, end - start))
        start = end


_FOUND = "part string, lang string, source string, item string, value bigint"


def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, with its language's sources and totals: each two sources' summed divergence, and each source's
    TOP terms that it has more of than its language."""
    for batch in it:
        for row in range(batch.num_rows):
            lang, kept_terms, kept = batch.column("lang")[row].as_py(), batch.column("kept_terms")[row].as_py(), batch.column("terms")[row].values
            names, sums = batch.column("all_sources")[row].values, batch.column("sums")[row].values.to_numpy()
            ids, counts = (batch.column(c)[row].values.to_numpy() for c in ("ids", "counts"))
            size = len(kept)
            of = pc.index_in(batch.column("sources")[row].values, names).to_numpy()
            whole = np.zeros(size, np.int64)
            np.add.at(whole, ids, counts)
            q = shares(whole, int(sums.sum()), kept_terms)

            def vectors(first: int) -> tuple[np.ndarray, np.ndarray]:
                """Counts and shares of the sources from `first` on, one dense vector each."""
                mine = (of >= first) & (of < first + SOURCES)  # noqa: B023
                n = min(SOURCES, len(names) - first)  # noqa: B023
                dense = np.zeros(n * size, np.int64)  # noqa: B023
                dense[(of[mine] - first) * size + ids[mine]] = counts[mine]  # noqa: B023
                dense = dense.reshape(n, size)  # noqa: B023
                return dense, shares(dense, sums[first : first + n, None], kept_terms)  # noqa: B023

            part, left, item, value = [], [], [], []
            for i in range(0, len(names), SOURCES):
                dense, p = vectors(i)
                more = np.where((dense > 0) & (p > q), divergences(p, q), -1)
                for k in range(len(p)):
                    best = np.argsort(-more[k], kind="stable")[:TOP]  # ids keep the order of terms
                    best = best[more[k][best] >= 0]
                    part.append(pa.array(["term"] * len(best), pa.string()))
                    left.append(np.full(len(best), i + k))
                    item.append(kept.take(pa.array(best)))
                    value.append(more[k][best])
                for j in range(i, len(names), SOURCES):
                    other = p if i == j else vectors(j)[1]
                    for k in range(len(p)):
                        rest = np.arange(k + 1 if i == j else 0, len(other))
                        if len(rest):
                            part.append(pa.array(["pair"] * len(rest), pa.string()))
                            left.append(np.full(len(rest), i + k))
                            item.append(names.take(pa.array(j + rest)))
                            value.append(divergences(other[rest], p[k]).sum(1))
            if part:
                columns = [pa.concat_arrays(part), pa.array([lang] * sum(map(len, part)), pa.string()), names.take(pa.array(np.concatenate(left))), pa.concat_arrays(item), pa.array(np.concatenate(value), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "lang", "source", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of `docs` (text, lang, source).

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that are in
    at least LEAST of its documents; a group's share of a term is smoothed, and two shares diverge by
    floor((p - q)^2 / (p + q)). Part `pair` ranks the other sources of a language by divergence over all kept terms,
    part `term` the TOP kept terms that a source has more of than its language. Ties go to the item that is least in
    UTF-8. Nulls are empty; every row is a document, repeated ones too; texts of any length count whole. A language
    that keeps no term gives pairs of value 0; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups, kept = written(rows.select("lang", "source").distinct(), "groups"), kept_counts(rows)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = kept.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term")
    parts = written(sorted_.mapInArrow(chunks, _CHUNK).withColumn("at", F.monotonically_increasing_id()), "chunks")
    # chunks are few but large, so each language's are dealt over many tasks, each with the language's totals
    every = totals(groups, kept).withColumnRenamed("sources", "all_sources").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    told = parts.withColumn("deal", F.pmod(F.xxhash64("at"), F.lit(DEALT)).cast("int")).join(every, ["lang", "deal"])
    found = written(told.mapInArrow(compared, _FOUND), "found")
    near = found.where("part = 'pair'").select("lang", "source", "item", "value")
    back = near.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    none = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item").withColumn("value", F.lit(0).cast("bigint"))
    pairs = near.unionByName(back).unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    out = ["lang", "source", "part", "item", "value"]
    top = found.where("part = 'term'").select(*out, rank).where(F.col("rank") <= TOP)
    return pairs.select(*out, rank).unionByName(top)
