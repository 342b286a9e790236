"""Chat formatting from event logs: reconstruct messages, escape them, render them with a loss mask.

A log row is an event of a conversation: `open` starts a message with a role and a first text, `delta` adds text,
`edit` replaces the text so far, `regenerate` discards it. A message stands in its conversation where the sequence
of its first event puts it. Events are dealt by ranges of (conversation, that sequence), so one conversation, however
long, is spread over many tasks while each message stays whole; within a task they are sorted by sequence and folded
into final messages one at a time. Rendered messages leave a task in blocks.

Control strings inside texts are escaped so that no text can open or close a turn: a backslash doubles and `<|`
becomes `<\\|`. Roles escape line breaks as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Characters of rendered text after which a block is closed.
BLOCK = 1 << 20
OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str, text: str, learn: bool) -> tuple[str, tuple[int, int] | None]:
    """The turn, and where in it the loss applies: the escaped text alone."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", (len(head), len(head) + len(body)) if learn else None


class Fold:
    """One message under reconstruction."""

    def __init__(self, role: str, text: str):
        self.role, self.parts = role, [text]

    def apply(self, kind: str, text: str) -> None:
        if kind == DELTA:
            self.parts.append(text)
        elif kind == EDIT:
            self.parts = [text]
        elif kind == REGENERATE:
            self.parts = []
        else:
            raise ValueError(f"unknown event kind: {kind!r}")

    def text(self) -> str:
        return "".join(self.parts)


def messages(events: Iterator[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """(conversation, role, text) of sorted events (conversation, message, kind, role, text), one message at a time.

    Each `open` starts a message, even under a number in use; the other kinds go to the message opened last under
    their number. One without an open message of its number starts it, with the event's role.
    """
    key, fold = None, None
    for conv, message, kind, role, text in events:
        if fold is not None and (kind == OPEN or key != (conv, message)):
            yield key[0], fold.role, fold.text()
            fold = None
        if fold is None:
            fold = Fold(role or "", (text or "") if kind == OPEN else "")
            key = (conv, message)
            if kind == OPEN:
                continue
        fold.apply(kind, text or "")
    if fold is not None:
        yield key[0], fold.role, fold.text()


def format_conversations(events: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, part, text, mask): the formatted conversations in blocks.

    `events` has conv_id, seq, message, kind, role and text. A conversation's blocks, in order of `part`, put end
    to end are its formatted text; `mask` lists (start, end) within the block, in code points, where the loss
    applies. Null texts and roles are empty, null numbers sort first, and a null conv_id is a conversation of its
    own. Messages stand by the least seq of their events, then by number. Events of one message that tie in seq are
    taken in the order open, regenerate, edit, delta, then by role and text; repeated rows are repeated events. Empty
    tables give no rows; other columns are not read.
    """
    rank = F.when(F.col("kind") == OPEN, 0).when(F.col("kind") == REGENERATE, 1).when(F.col("kind") == EDIT, 2).otherwise(3)
    log = events.select("conv_id", "message", "seq", rank.alias("rank"), "role", "text", "kind")
    began = log.groupBy(F.col("conv_id").alias("of_conv"), F.col("message").alias("of_message")).agg(F.when(F.count_if(F.col("seq").isNull()) == 0, F.min("seq")).alias("first"))
    log = log.join(began, F.col("conv_id").eqNullSafe(F.col("of_conv")) & F.col("message").eqNullSafe(F.col("of_message"))).drop("of_conv", "of_message")
    order = ["conv_id", "first", "message", "seq", "rank", "role", "text"]
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = log.repartitionByRange(n, "conv_id", "first", "message").sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "message", "kind", "role", "text", F.spark_partition_id().cast("long").alias("task"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = 0

        def rows() -> Iterator[tuple]:
            nonlocal task
            for batch in it:
                if batch.num_rows:
                    task = batch.column(5)[0].as_py()
                yield from zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True)

        def block(conv, part, pieces, mask):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((conv, part, "".join(pieces), mask), kinds, strict=True)], names=["conv_id", "part", "text", "mask"])

        now, part, pieces, mask, size = None, 0, [], [], 0
        for conv, role, text in messages(rows()):
            if pieces and (conv != now or size >= BLOCK):
                yield block(now, (task << 32) + part, pieces, mask)
                part, pieces, mask, size = part + 1, [], [], 0
            now = conv
            piece, span = render(role, text, role in learn_roles)
            if span:
                mask.append([size + span[0], size + span[1]])
            pieces.append(piece)
            size += len(piece)
        if pieces:
            yield block(now, (task << 32) + part, pieces, mask)

    return dealt.mapInArrow(batches, "conv_id bigint, part bigint, text string, mask array<array<bigint>>")


def read_back(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in formatted text."""
    for m in _TURN.finditer(text):
        yield unescape_role(m[1]), unescape(m[2])


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted blocks: turns, their digest, the masked text's size and digest.

    The digests run over a conversation from end to end, which fixes the order of its blocks; they are hashed as
    they come, so memory holds one block, and a block's rows were folded before they are brought together.
    """
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def closed():
            turns, turns_sha, chars, loss_sha, size = state
            values = (now, turns, turns_sha.hexdigest(), chars, loss_sha.hexdigest(), size)
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in it:
            for conv, text, mask in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        yield closed()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = text.as_py()
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in mask.as_py():
                    said = unescape(text[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
        if state is not None:
            yield closed()

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return dealt.select("conv_id", "text", "mask").mapInArrow(batches, schema)
