"""Secret scanning: fixed patterns, and formats inferred from the credentials that those find.

Labelled credentials grow a prefix tree whose states are merged where their statistics are compatible (the ALERGIA
algorithm, in red-blue order), which gives a probabilistic automaton over character classes. Every candidate string
of a text is scored by its likelihood under the automaton against its likelihood as ordinary text; a candidate well
above is a span of kind `format`, unless a fixed pattern marks just these letters. Spans of the fixed patterns stay
whatever their score, which they tell as well.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
#: The same in the syntax of Arrow's matcher: texts without any match need no closer look.
ANY_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"""
#: Candidates: runs of credential letters, this long at least.
CANDIDATE, LEAST = re.compile(r"[A-Za-z0-9+/_=-]+"), 16
ANY_CANDIDATE = r"[A-Za-z0-9+/_=-]{16}"
#: Labelled credentials that the automata learn from, per kind, and sampled ordinary candidates for the background.
SAMPLE = 2_000
#: Bytes of the longest string that teaches; longer ones are scored whole all the same.
LONGEST = 4_096
#: Confidence of the compatibility test, and the log-likelihood ratio per letter from which a candidate is a secret.
ALPHA, MARGIN = 0.05, 0.35
#: Rounds in which candidates are weighed between the automata and the background that is learnt from them.
ROUNDS = 12


def letter_class(c: str) -> str:
    """The automata read classes: a digit, a letter a-f, another lower-case one, A-F, another upper-case one, or the mark itself."""
    if c.isdigit():
        return "9"
    if c.islower():
        return "a" if c <= "f" else "z"
    if c.isupper():
        return "A" if c <= "F" else "Z"
    return c


_CLASS = str.maketrans({chr(i): letter_class(chr(i)) for i in range(128)})


@dataclass
class State:
    """A state with the strings that passed, those that ended, and those that went on by class."""

    passed: int = 0
    ended: int = 0
    count: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic deterministic automaton learnt from strings by state merging."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.states = [State()]
        for s in sorted(strings):
            at = self.states[0]
            at.passed += 1
            for c in s.translate(_CLASS):
                if c not in at.to:
                    at.to[c] = len(self.states)
                    self.states.append(State())
                at.count[c] = at.count.get(c, 0) + 1
                at = self.states[at.to[c]]
                at.passed += 1
            at.ended += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._log = self._likelihoods()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two states, and those reached by the same strings from them, have like frequencies."""
        todo = [(a, b)]
        while todo:
            x, y = (self.states[i] for i in todo.pop())
            if not x.passed or not y.passed:
                continue
            if self._differ(x.ended, x.passed, y.ended, y.passed):
                return False
            for c in {*x.count, *y.count}:
                if self._differ(x.count.get(c, 0), x.passed, y.count.get(c, 0), y.passed):
                    return False
                if c in x.to and c in y.to:
                    todo.append((x.to[c], y.to[c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree's counts to a state and on along its transitions; branches it lacks are hung on."""
        todo = [(into, tree)]
        while todo:
            i, t = todo.pop()
            x, y = self.states[i], self.states[t]
            x.passed += y.passed
            x.ended += y.ended
            for c, n in y.count.items():
                x.count[c] = x.count.get(c, 0) + n
                if c in x.to:
                    todo.append((x.to[c], y.to[c]))
                else:
                    x.to[c] = y.to[c]

    def _merge_states(self) -> None:
        red = [0]
        while True:
            blue = [(r, c, t) for r in red for c, t in self.states[r].to.items() if t not in red]
            if not blue:
                break
            r, c, b = max(blue, key=lambda x: (self.states[x[2]].passed, -x[2]))
            into = next((q for q in red if self._compatible(q, b)), None)
            if into is None:
                red.append(b)
            else:
                self.states[r].to[c] = into
                self._fold(into, b)
        at = {r: i for i, r in enumerate(red)}
        self.states = [self.states[r] for r in red]
        for s in self.states:
            s.to = {c: at[t] for c, t in s.to.items()}

    def _likelihoods(self) -> list[dict[str, tuple[float, int]]]:
        """Per state: class -> (log probability, next state); the end is ''. Unseen classes keep a small part."""
        out = []
        for s in self.states:
            total = s.passed + len(s.count) + 2
            row = {c: (math.log((n + 1) / total), s.to[c]) for c, n in s.count.items()}
            row[""] = (math.log((s.ended + 1) / total), -1)
            row["?"] = (math.log(1 / total / 8), -1)
            out.append(row)
        return out

    def score(self, s: str) -> float:
        """Log-likelihood of the classes of `s`; a string that leaves the automaton pays the unseen part from there on."""
        at, total = 0, 0.0
        for k, c in enumerate(s := s.translate(_CLASS)):
            step = self._log[at].get(c)
            if step is None:
                return total + self._log[at]["?"][0] * (len(s) - k)
            total, at = total + step[0], step[1]
        return total + self._log[at][""][0]


class Background:
    """Ordinary candidates as a chain over classes, each counted by its weight."""

    def __init__(self, strings: list[str], weights: list[float] | None = None):
        pairs: dict[tuple[str, str], float] = {}
        first: dict[str, float] = {}
        for s, w in zip(strings, weights or [1] * len(strings), strict=True):
            s = s.translate(_CLASS)
            for a, b in zip("^" + s, s + "$", strict=True):
                pairs[a, b] = pairs.get((a, b), 0) + w
                first[a] = first.get(a, 0) + w
        self.log = {k: math.log((n + 0.1) / (first[k[0]] + 1.2)) for k, n in pairs.items()}
        self.none = {a: math.log(0.1 / (n + 1.2)) for a, n in first.items()}

    def score(self, s: str) -> float:
        s, low = s.translate(_CLASS), math.log(1 / 12)
        return sum(self.log.get((a, b), self.none.get(a, low)) for a, b in zip("^" + s, s + "$", strict=True))


def ordinary(strings: list[str], automata: list[Automaton]) -> Background:
    """The background, from unlabelled candidates that may hold secrets: expectation maximisation, in which each
    counts for as much as it is likelier ordinary than of a labelled format."""
    background, secret = Background(strings), 0.5
    if not automata or not strings:
        return background
    formats = [max(m.score(s) for m in automata) for s in strings]
    for _ in range(ROUNDS):
        prior = math.log((1 - secret) / secret)
        odds = [background.score(s) - f + prior for s, f in zip(strings, formats, strict=True)]
        weights = [1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for x in odds]
        secret = min(1 - 1e-6, max(1e-6, 1 - sum(weights) / len(weights)))
        background = Background(strings, weights)
    return background


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the fixed patterns, leftmost and non-overlapping within each kind."""
    out = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return out


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, letters, whether no base span touches them) of the runs of credential letters, but for those that
    are the credential of a base span."""
    base = sorted(base)
    starts, reach = [a for a, _, _, _ in base], list(accumulate((b for _, b, _, _ in base), max))
    marked = {(b - len(credential), b) for _, b, _, credential in base}
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() >= LEAST and m.span() not in marked:
            before = bisect_left(starts, m.end())
            yield m.start(), m.end(), m[0], not (before and reach[before - 1] > m.start())


def worth_a_look(texts: pa.Array) -> pa.Array:
    """Whether a text can hold a span of any kind; most cannot."""
    return pc.or_(pc.match_substring_regex(texts, ANY_BASE), pc.match_substring_regex(texts, ANY_CANDIDATE))


def labelled(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, credential) of the base spans, and of all other candidates with kind `other`: what the models learn from."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kinds, found = [], []
            texts = pc.fill_null(batch.column(0), "")
            for text in texts.filter(worth_a_look(texts)).to_pylist():
                base = base_spans(text)
                for _, _, kind, credential in base:
                    kinds.append(kind)
                    found.append(credential)
                for _, _, s, free in candidates(text, base):
                    if free:
                        kinds.append("other")
                        found.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=["kind", "credential"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(batches, "kind string, credential string")


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[str, Automaton], Background]:
    """An automaton per kind, and the background, each from at most `sample` distinct strings of LONGEST bytes at most:
    those whose hashes are smallest over the whole table, so the choice depends on no order or partition."""
    strings = written(labelled(docs, text_col).where(F.octet_length("credential") <= LONGEST).distinct(), "credentials")
    kept = {}
    for kind in (*KINDS[:3], "other"):
        rows = strings.where(F.col("kind") == kind).orderBy(F.xxhash64("credential"), "credential").limit(sample)
        kept[kind] = [r.credential for r in rows.collect()]
    automata = {k: Automaton(v) for k, v in kept.items() if v and k != "other"}
    return automata, ordinary(kept["other"], list(automata.values()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, spans): one row per row of `docs`; spans is an array of (start, end, kind, margin) in code points, end
    exclusive, by start and then kind in the order assign, access, hex, format. `margin` is the log-likelihood ratio
    a letter of the credential, or null where nothing was learnt.

    Null and empty texts have no spans; texts of any length are scanned whole; of spans that start together the kind
    decides; repeated rows each get theirs; an empty table gives no rows. Without any
    base span in the table nothing is learnt and no format span is added. Only the id and the text are read.
    """
    automata, background = learn(docs, text_col, sample)
    kind_of_id = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def margin(s: str) -> float | None:
        return (max(m.score(s) for m in automata.values()) - background.score(s)) / len(s) if automata else None

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = pc.fill_null(batch.column(1), "")
            look = worth_a_look(texts).to_pylist()
            out = []
            for i, wanted in enumerate(look):
                if not wanted:
                    out.append([])
                    continue
                text = texts[i].as_py()
                base = base_spans(text)
                spans = [(a, b, k, margin(s)) for a, b, k, s in base]
                spans += [x for a, b, s, _ in candidates(text, base) if automata and (x := (a, b, "format", margin(s)))[3] >= MARGIN]
                spans.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                out.append([{"start": a, "end": b, "kind": k, "margin": m} for a, b, k, m in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("margin", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(batches, f"id {kind_of_id}, spans array<struct<start: bigint, end: bigint, kind: string, margin: double>>")
    return found.withColumnRenamed("id", id_col)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per kind, the base spans' digest, all spans as text, and the margin of each span in that order, so that
    what the automata make of every span is told, beside the other columns of `scanned`."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "format")
    others = [c for c in scanned.columns if c != "spans"]
    return scanned.select(*others, *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.transform("spans", lambda s: F.round(s["margin"], 6)).alias("margins"))
