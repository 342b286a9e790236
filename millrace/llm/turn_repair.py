"""Repair of conversation structure: the cheapest edits that make a conversation alternate as it should.

A repaired conversation is empty, or has an optional system turn and then user and assistant turns in pairs. Which
turns stay, as they are or under another role, is a shortest path over retained turns: a state is the role of the
turn retained last, what lies between two retained turns is deleted (a running sum of deletions is added to each
state's minimum as the turns go by, so no pair of turns is ever looked at), and the two roles tell how many turns
have to be inserted between them. Of equally cheap paths the one whose audit string is least in ASCII wins. All
audits up to one turn have equally many letters for turns and end in one of them, so none is a prefix of another,
and their order among four states is all that the next turn has to know.

The path is found in segments of at most SEGMENT turns, for each state that a segment may be entered in; what a
segment does to the four states is a small table, so a conversation of any length is put together from its
segments' tables and then written out segment by segment. Segments of many conversations go through numpy side by
side, one turn of each at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hot_keys, in_order, spread_join, written

#: Turns of one segment.
SEGMENT = 4_096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing retained yet, or the initial of the turn retained last.
STATES = ("", "s", "u", "a")
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What a step appends to the audit, in ASCII order.
STEPS = ("D", "IK", "IR", "K", "R")
DROP, INSERTED = 0, {False: 3, True: 1}
#: Turns to insert before a retained user or assistant turn, by the state before it, and at the end.
BEFORE = {USER: (0, 0, 1, 0), ASSISTANT: (1, 1, 0, 1)}
AT_END = (0, 2, 1, 0)
#: Costs from here on mean that there is no way.
FAR = 1 << 50
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
#: Initials that may stand beside each other, as 4 * one + the next.
LEGAL = (SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER)
NAMES = ("", "system", "user", "assistant")
#: Letters of repaired text in one row.
PIECE = 1 << 20


def advance(cost: np.ndarray, rank: np.ndarray, role: np.ndarray, must_go: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs and audit ranks (n, 4) of n paths after one more turn each, and the way taken: state before * 8 + step."""
    n = len(role)
    far = np.full(n, FAR)
    found, order, way = np.full((n, 4), FAR), np.zeros((n, 4), np.int64), np.zeros((n, 4), np.uint8)
    for state in range(4):
        ways = [(state, np.full(n, DROP), cost[:, state] + DELETE)]
        if state == SYSTEM:
            kept = np.where((role == SYSTEM) & ~must_go, cost[:, NONE] + KEEP + TRUNCATED * cut, far)
            ways.append((NONE, np.full(n, INSERTED[False]), kept))
        elif state != NONE:
            rerole = role != state
            price = np.where(must_go, far, REROLE * rerole + TRUNCATED * cut)
            ways += [(e, INSERTED[k > 0] + rerole, cost[:, e] + price + INSERT * k) for e, k in enumerate(BEFORE[state])]
        # costs first, then the audit: of unlike states by their rank, of one state by what is appended
        keys = np.stack([np.minimum(c, FAR) * 32 + rank[:, e] * 5 + step for e, step, c in ways], 1)
        best = keys.argmin(1)
        at = np.arange(n)
        found[:, state] = keys[at, best] // 32
        order[:, state] = keys[at, best] % 32
        way[:, state] = np.stack([e * 8 + step for e, step, _ in ways], 1)[at, best]
    return found, order.argsort(1, kind="stable").argsort(1, kind="stable"), way


def paths(starts: np.ndarray, ends: np.ndarray, entry: np.ndarray, role: np.ndarray, must_go: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Of segments [start, end) of turns, each entered in a state: costs and ranks of the states at its end, and the
    ways as (segments still running, ways) turn by turn."""
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    length = (ends - starts)[order]
    cost, rank = np.full((len(order), 4), FAR), np.tile(np.arange(4), (len(order), 1))
    cost[np.arange(len(order)), entry[order]] = 0
    ways = []
    for t in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t, "left"))
        at = starts[order[:live]] + t
        cost[:live], rank[:live], way = advance(cost[:live], rank[:live], role[at], must_go[at], cut[at])
        ways.append((order[:live], way))
    back = np.argsort(order, kind="stable")
    return cost[back], rank[back], ways


def walk_back(ways: list, state: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The step and the state after it of each of n turns, given the state at the end of each segment."""
    step, after, state = np.zeros(n, np.int64), np.zeros(n, np.int64), state.copy()
    for t in range(len(ways) - 1, -1, -1):
        live, way = ways[t]
        at = starts[live] + t
        taken = way[np.arange(len(live)), state[live]]
        step[at], after[at] = taken % 8, state[live]
        state[live] = taken // 8
    return step, after


def damage(turns: DataFrame) -> DataFrame:
    """The turns with a known share of faults: by crc32(`conv_id:turn`) % 20, 0 drops a row, 1 empties its text, 2
    takes the `[.!?]` out of it, 3 repeats it and 4 makes its role user. A null is one space, also in the sum."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def conversation(rows: DataFrame) -> list[Column]:
    """conv_id as two columns that are never null."""
    return [F.col("conv_id").isNull().cast("int").alias("no_id"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("id")]


def with_faults(turns: DataFrame) -> DataFrame:
    """(no_id, id, turn, role, text, copy, fault): the turns with their first fault, 1 blank, 2 duplicate, 3 truncated, 0 none.

    Rows that are equal in everything are folded into one with their number, and only roles and digests of texts are
    brought together; all but the first row of a (conversation, role, text) are duplicates.
    """
    said = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(*conversation(turns), F.col("turn").cast("bigint").alias("turn"), *said)
    folded = rows.groupBy("no_id", "id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    folded = written(folded.withColumn("said", F.sha2("text", 256)), "folded")
    keys = ["no_id", "id", "role", "said"]
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = written(folded.groupBy(*keys).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1"), "repeated")
    hot = hot_keys(first.select(*keys, F.col("places").alias("n")), keys, folded.count())
    again = spread_join(folded.select(*keys, "turn"), first.select(*keys, "first"), keys, "turn", hot).where(~place.eqNullSafe(F.col("first")))
    again = again.select(*[F.col(c).alias(f"again_{c}") for c in (*keys, "turn")])
    same = [F.col(c) == F.col(f"again_{c}") for c in keys]
    told = folded.join(again, [*same, F.col("turn").eqNullSafe(F.col("again_turn"))], "left")
    told = told.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    end = F.rtrim("text", F.lit(BLANK))
    fault = F.when(end == "", 1).when(F.col("again_id").isNotNull() | (F.col("copy") > 1), 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return told.select("no_id", "id", "turn", "role", "text", "copy", fault.alias("fault"))


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows sorted by their first three columns (no_id, id, segment), with starts and ends of the segments among
    them; a batch's last segment waits for the next batch."""
    held = None
    for batch in it:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if held.num_rows:
            keys = [held.column(k).to_numpy() for k in range(3)]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(edge):
                yield held.slice(0, edge[-1]), np.concatenate([[0], edge[:-1]]), edge
                held = held.slice(edge[-1])
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64), np.array([held.num_rows])


def _flags(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    fault = rows.column("fault").to_numpy()
    return rows.column("role_is").to_numpy(), (fault == 1) | (fault == 2), fault == 3, fault


_TABLE = "no_id int, id bigint, segment bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first int, last int, costs array<bigint>, ranks array<bigint>"
_WAY = "no_id int, id bigint, segment bigint, entry int, exit int, last boolean, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def tables(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each segment does: counts of its faults, and for each state before it the costs and ranks of those after it."""
    for rows, starts, ends in _segments(it):
        role, must_go, cut, fault = _flags(rows)
        cost, rank, _ = paths(np.repeat(starts, 4), np.repeat(ends, 4), np.tile(np.arange(4), len(starts)), role, must_go, cut)
        of = np.repeat(np.arange(len(starts)), ends - starts)
        count = lambda hit: np.bincount(of[hit], minlength=len(starts))  # noqa: E731, B023
        pair = role[:-1] * 4 + role[1:]
        odd = ~np.isin(pair, LEGAL) & (of[1:] == of[:-1])
        columns = [*(rows.column(k).take(pa.array(starts)) for k in range(3)), *(count(fault == k) for k in (1, 2, 3)), np.bincount(of[1:][odd], minlength=len(starts)), role[starts], role[ends - 1]]
        columns = [pa.array(c) for c in columns] + [pa.array(list(x.reshape(-1, 16)), pa.list_(pa.int64())) for x in (cost, rank)]
        yield pa.RecordBatch.from_arrays(columns, names=_names(_TABLE)).cast(_arrow(_TABLE))


def fold(segments: list[dict]) -> Iterator[tuple]:
    """(segment, entry, exit, last, cost, faults ...) of one conversation's segments in order; the cost and the
    faults, of the whole conversation, stand in the last row."""
    cost, rank, chosen = [0, FAR, FAR, FAR], [0, 1, 2, 3], []
    for s in segments:
        best = [min((cost[e] + s["costs"][4 * e + x], rank[e] * 4 + s["ranks"][4 * e + x], e) for e in range(4)) for x in range(4)]
        chosen.append([b[2] for b in best])
        cost, keys = [min(b[0], FAR) for b in best], sorted(b[1] * 4 + x for x, b in enumerate(best))
        rank = [keys.index(b[1] * 4 + x) for x, b in enumerate(best)]
    state = min(range(4), key=lambda x: (cost[x] + INSERT * AT_END[x], rank[x]))
    total, ways = cost[state] + INSERT * AT_END[state], []
    for s, before in zip(reversed(segments), reversed(chosen), strict=True):
        ways.append((s["segment"], before[state], state))
        state = before[state]
    seams = sum(a["last"] * 4 + b["first"] not in LEGAL for a, b in zip(segments, segments[1:], strict=False))
    counts = [sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal")]
    counts[3] += seams
    for k, way in enumerate(reversed(ways)):
        yield (*way, True, total, *counts) if k == len(ways) - 1 else (*way, False, *[0] * 5)


def ways(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after every segment on the cheapest path, from rows (no_id, id, tables in order)."""
    for batch in it:
        found = [(no_id, id_, *way) for no_id, id_, own in zip(*[c.to_pylist() for c in batch.columns], strict=True) for way in fold(own)]
        columns = list(zip(*found, strict=True)) or [[]] * 11
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(_WAY), strict=True)], schema=_arrow(_WAY))


_PIECE = "no_id int, id bigint, segment bigint, place int, last boolean, audit string, text string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the repaired turns of each segment, in pieces of about PIECE letters; each turn ends its line."""
    for rows, starts, ends in _segments(it):
        role, must_go, cut, _ = _flags(rows)
        entry, exit_ = (rows.column(c).to_numpy()[starts].astype(np.int64) for c in ("entry", "exit"))
        step, after = walk_back(paths(starts, ends, entry, role, must_go, cut)[2], exit_, starts, rows.num_rows)
        roles, texts, found = rows.column("role"), rows.column("text"), []
        facts = [c.to_pylist() for c in rows.select(["no_id", "id", "segment", "last", "cost", "blank", "duplicate", "truncated", "illegal"]).take(pa.array(starts)).columns]
        for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            no_id, id_, segment, last, *counts = [f[k] for f in facts]
            audit, lines, size, place = [], [], 0, 0
            for i in range(start, end):
                done, state = STEPS[step[i]], int(after[i])
                audit.append(done)
                if done[0] == "I":
                    lines.append(f"{NAMES[USER if state == ASSISTANT else ASSISTANT]}:\n")
                if done[-1] != "D":
                    lines.append(f"{roles[i].as_py() if done[-1] == 'K' else NAMES[state]}:{texts[i].as_py()}\n")
                    size += len(lines[-1])
                if size >= PIECE:
                    found.append((no_id, id_, segment, place, False, "".join(audit), "".join(lines), *[0] * 5))
                    audit, lines, size, place = [], [], 0, place + 1
            if last:
                audit.append("I" * AT_END[exit_[k]])
                lines += [f"{NAMES[x]}:\n" for x in (USER, ASSISTANT)[2 - AT_END[exit_[k]] :]]
            found.append((no_id, id_, segment, place, last, "".join(audit), "".join(lines), *counts))
        columns = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(_PIECE), strict=True)], schema=_arrow(_PIECE))


_REPAIR = "no_id int, id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces in order, which are hashed as they come."""
    sha, audit, first = hashlib.sha256(), [], True
    for batch in it:
        found = []
        for no_id, id_, _, _, last, done, text, cost, *counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            audit.append(done)
            if text:  # a line's end comes before the next line, not after the last
                sha.update(("" if first else "\n").encode() + text[:-1].encode())
                first = False
            if last:
                found.append((no_id, id_, *counts, cost, "".join(audit), sha.hexdigest()))
                sha, audit, first = hashlib.sha256(), [], True
        columns = list(zip(*found, strict=True)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(_REPAIR), strict=True)], schema=_arrow(_REPAIR))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def repair_plan(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (no_id, id, segment, at, role, role_is, text, fault) in order, cut into segments, and each segment's
    states before and after it on its conversation's cheapest path, with the conversation's cost and faults."""
    order = [F.col(c) for c in ("no_id", "id", "turn", "role")]
    placed, at = in_order(with_faults(turns), [*order, F.substr("text", F.lit(1), F.lit(64))], [*order, F.col("text"), F.col("copy")], "turns")
    initial = F.left("role", F.lit(1))
    role_is = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(NONE)
    segment = (F.col(at) / SEGMENT).cast("bigint").alias("segment")
    rows = placed.select("no_id", "id", segment, F.col(at).alias("at"), "role", role_is.cast("bigint").alias("role_is"), "text", "fault")
    key = ["no_id", "id", "segment"]
    told = rows.select(*key, "at", "role_is", "fault").repartition(*key).sortWithinPartitions(*key, "at").mapInArrow(tables, _TABLE)
    whole = told.groupBy("no_id", "id").agg(F.sort_array(F.collect_list(F.struct(*_names(_TABLE)[2:]))).alias("segments"))
    return rows, written(whole.mapInArrow(ways, _WAY), "ways")


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conv_id of
    `turns` (conv_id, turn, role, text); a conversation has at most 2^31 turns, as its audit is one string.

    Turns stand by number, null numbers first, then by role and text; a null role or text is one space, and a null
    conv_id is a conversation of its own. Repeated rows are duplicates. Rows go through tasks in segments, so a long
    conversation is spread, and a text of any length is only held by itself. An empty table gives no rows; other
    columns are not read. A conversation that loses all its turns has an empty audit and the digest of nothing.
    """
    rows, found = repair_plan(turns)
    key = ["no_id", "id", "segment"]
    done = rows.join(found, key).repartition(*key).sortWithinPartitions(*key, "at")
    names = [*key, "role", "role_is", "text", "fault", "entry", "exit", "last", "cost", "blank", "duplicate", "truncated", "illegal"]
    made = done.select(*names).mapInArrow(pieces, _PIECE).repartition("no_id", "id").sortWithinPartitions("no_id", "id", "segment", "place")
    by_id = turns.select(*conversation(turns), F.col("turn").cast("bigint").alias("turn")).groupBy("no_id", "id")
    gaps = by_id.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    out = made.mapInArrow(digests, _REPAIR).join(gaps, ["no_id", "id"])
    return out.select(F.when(F.col("no_id") == 0, F.col("id")).alias("conv_id"), "gaps", *_names(_REPAIR)[2:])


def repair_damaged(turns: DataFrame) -> DataFrame:
    """`repair` of the turns after `damage`, with a row for every conversation of `turns`, also one that lost all of
    its turns: zeros, an empty audit and the digest of nothing."""
    done = repair(damage(turns))
    all_ = turns.select(F.col("conv_id").cast("bigint").alias("original")).distinct()
    out = all_.join(done, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return out.select(F.col("original").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
