"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens lie end to end in one array of symbols. In each round every sequence finds its
lowest-rank adjacent pair and all its occurrences merge at once, in all sequences together; a sequence with no
mergeable pair is done, and its surviving symbols are its tokens. Since a merge makes a symbol whose own pairs all
rank higher, the rounds give what merging one pair at a time gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern that byte-level BPE vocabularies of this family are made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct strings whose counts a task remembers, and letters of one that it would remember: speed only.
REMEMBERED, SHORT = 400_000, 64
TABLE_BITS = 20
NONE = np.int32(2**31 - 1)
_loaded: dict[str, Merges] = {}


class Merges:
    """The merge ranks of a tokenizer file, as sorted arrays that a pair's code is looked up in."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if odd := unlike(spec):
            raise ValueError(f"{path}: not supported: {', '.join(odd)}")
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        codes = left << 32 | right
        # a sparse hash table by linear probing, a few per cent full, so nearly all look-ups are one gather
        self.keys, self.values = np.full(1 << TABLE_BITS, -1, np.int64), np.full(1 << TABLE_BITS, NONE, np.int32)
        self.made, rest, slot = made, np.arange(len(codes)), self.slot(codes)
        while len(rest):
            free = self.keys[slot] == -1
            at, who = np.unique(slot[free], return_index=True)
            who = np.flatnonzero(free)[who]
            self.keys[at], self.values[at] = codes[rest[who]], rest[who]
            stay = np.ones(len(rest), bool)
            stay[who] = False
            rest, slot = rest[stay], (slot[stay] + 1) & ((1 << TABLE_BITS) - 1)
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # direct look-up by pair of bytes covers the first round, where most pairs are
        self.first = np.full((256, 256), NONE, np.int32)
        self.first[:] = self.rank(self.byte_ids[:, None].astype(np.int64) << 32 | self.byte_ids[None, :])

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def rank(self, codes: np.ndarray) -> np.ndarray:
        """Ranks of pairs given as left id << 32 | right id; NONE where there is no merge."""
        slot = self.slot(codes)
        key = self.keys[slot]
        out = np.where(key == codes, self.values[slot], NONE)
        more = (key != codes) & (key != -1)
        while more.any():
            slot[more] = (slot[more] + 1) & ((1 << TABLE_BITS) - 1)
            key = self.keys[slot]
            out = np.where(more & (key == codes), self.values[slot], out)
            more &= (key != codes) & (key != -1)
        return out


def unlike(spec: dict) -> list[str]:
    """What a tokenizer file asks for and this module does not do; such a file would be counted wrongly."""
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["normalizer"] if spec.get("normalizer") else []
    odd += ["model"] if model.get("type", "BPE") != "BPE" else []
    odd += ["pre_tokenizer"] if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) else []
    return odd + [f"added token {t['content']!r}" for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the
    others, in order, for the code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def count_symbols(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """Symbols that survive in each of `pieces`."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    out = np.zeros(len(pieces), np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    symbols, seq = merges.byte_ids[raw], np.repeat(np.arange(len(pieces)), sizes)
    ranks = np.full(len(raw), NONE, np.int32)  # of the pair that starts at each symbol
    if len(raw) > 1:
        ranks[:-1] = np.where(seq[:-1] == seq[1:], merges.first[raw[:-1], raw[1:]], NONE)
    while len(symbols):
        starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        low = np.minimum.reduceat(ranks, starts)
        lengths = np.diff(np.append(starts, len(seq)))
        done = low == NONE
        if done.any():
            out[seq[starts[done]]] = lengths[done]
            stay = np.repeat(~done, lengths)
            symbols, seq, ranks = symbols[stay], seq[stay], ranks[stay]
            low, lengths = low[~done], lengths[~done]
            if not len(symbols):
                break
        lows = np.repeat(low, lengths)
        hit = ranks == lows
        at = np.flatnonzero(hit)
        # of overlapping occurrences (a run of one repeated symbol) every other one merges, from the left
        head = np.concatenate([[True], np.diff(at) != 1])
        if not head.all():
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
        symbols[at] = merges.made[ranks[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        new = np.cumsum(keep)[at] - 1
        symbols, seq, ranks = symbols[keep], seq[keep], ranks[keep]
        near = np.zeros(len(symbols), bool)
        near[new] = near[new[new > 0] - 1] = True
        touched = np.flatnonzero(near)
        inner = touched < len(symbols) - 1
        ranks[touched] = NONE
        t = touched[inner]
        t = t[seq[t] == seq[t + 1]]
        ranks[t] = merges.rank(symbols[t].astype(np.int64) << 32 | symbols[t + 1])
    return out


class Counter:
    """Counts of whole texts, with what it has counted before at hand; what it keeps is bounded."""

    def __init__(self, merges: Merges):
        self.merges, self.find = merges, regex.compile(PATTERN).findall
        self.apart = regex.compile(r"\s ").search
        self.by_chunk: dict[str, int] = {}
        self.by_piece: dict[str, int] = {}

    def chunks(self, text: str) -> list[str]:
        """Parts of the text that pre-tokens don't cross: it may be cut before any space that follows a visible
        character, as pre-tokens hold a space only at their start or in runs of white space."""
        if self.apart(text) is None:
            first, *rest = text.split(" ")
            return [first, *[" " + r for r in rest]]
        return regex.split(r"(?<=\S)(?= )", text)

    def count(self, texts: list[str]) -> list[int]:
        """Special strings count one each and split the text, as the library's default has it."""
        out, parts = [0] * len(texts), []
        for i, text in enumerate(texts):
            if self.merges.split is not None and any(s in text for s in self.merges.special):
                cut = self.merges.split.split(text)
                out[i] = len(cut) // 2
                parts.append([c for piece in cut[::2] if piece for c in self.chunks(piece)])
            else:
                parts.append(self.chunks(text))
        seen = self.by_chunk
        if len(seen) > REMEMBERED:
            seen.clear()
        fresh = list({c for found in parts for c in found if c not in seen})
        new = dict(zip(fresh, self.count_chunks(fresh), strict=True))
        long = {c: n for c, n in new.items() if len(c) > SHORT}
        seen.update(new)
        for i, found in enumerate(parts):
            out[i] += sum(map(seen.__getitem__, found))
        for c in long:
            del seen[c]
        return out

    def count_chunks(self, chunks: list[str]) -> list[int]:
        if len(self.by_piece) > REMEMBERED:
            self.by_piece.clear()
        seen, parts = self.by_piece, [self.find(c) for c in chunks]
        fresh = list({p for found in parts for p in found if p not in seen})
        seen.update(zip(fresh, count_symbols([p.encode() for p in fresh], self.merges).tolist(), strict=True))
        out = [sum(map(seen.__getitem__, found)) for found in parts]
        for p in fresh:
            if len(p) > SHORT:
                del seen[p]
        return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit), over whole texts.

    `tokenizer` is the path of a byte-level BPE file in the tokenizers library's JSON form, present on every
    executor. Null and empty texts have no bytes and no tokens; repeated rows each give a row; an empty table
    gives none. Only the id and the text are read, so other columns cannot clash.
    """
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Merges(tokenizer)
        merges = _loaded[tokenizer]
        counter = Counter(merges)
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens, start, size = [], 0, 0
            for i, text in enumerate(texts):  # pre-tokens of some MB of text at a time
                size += len(text)
                if size > 1 << 20 or i + 1 == len(texts):
                    tokens += counter.count(texts[start : i + 1])
                    start, size = i + 1, 0
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_to_count"))
    return rows.mapInArrow(batches, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
