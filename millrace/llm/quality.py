"""Quality classifier from weak labels: heuristic labellers, their accuracies by EM, and a hashed linear scorer.

Overlapping heuristics vote good, bad or nothing on every document. Expectation-maximisation over the counts of
vote patterns estimates, without any labelled row, how each labeller votes on good and on bad documents, which
turns a pattern into the probability that its document is good. These soft labels of a bounded sample train a
logistic scorer on hashed word-shape features, which then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mixed, runs, word_hashes
from .shared import written

#: Hashed feature space, and the most documents that train the scorer: those with the smallest hashes of id and text.
FEATURES, SAMPLE = 1 << 14, 20_000
#: The most bytes of features, 8 for each kind that a document has, that train the scorer; more, and fewer documents do.
SAMPLE_BYTES = 256 << 20
THRESHOLD = 0.5
#: Each labeller: a measure, the value above which it votes bad and that below which it votes good.
LABELLERS = (
    ("capitals", 0.5, 0.15),  # upper-case letters among letters
    ("symbols", 0.04, 0.01),  # marks that prose rarely has among characters
    ("repeats", 0.2, 0.02),  # words that equal the word before
    ("wordless", 0.12, 0.02),  # words without letter or digit
    ("shouted", 0.4, 0.1),  # words in capitals
    ("exclaimed", 0.2, 0.03),  # words that end in ! or ?
    ("marked", 0.25, 0.03),  # words with two or more such marks
    ("unstopped", 1.0, 0.97),  # words that end no sentence or clause; short prose may lack them, so it never votes bad
)
BAD, NONE, GOOD = 0, 1, 2

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = True
_LAST = np.full(256, 4, np.int64)
_LAST[_ALPHA] = 0
_LAST[0x80:0xC0] = 0
_LAST[_DIGIT] = 5
_LAST[ord(".")], _LAST[ord(",")], _LAST[ord("!")], _LAST[ord("?")] = 1, 2, 3, 3


@dataclass
class Words:
    """The words of a run of documents by shape."""

    counts: np.ndarray  # words per document
    shape: np.ndarray
    rates: np.ndarray  # documents x labellers


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    hashes, starts, ends, counts = word_hashes(data, offsets)
    n_docs = len(counts)
    if not len(starts):
        return Words(counts, np.zeros(0, np.int64), np.zeros((n_docs, len(LABELLERS))))
    upper = _UPPER[data]
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    n_upper, n_alpha, n_mark = per_word(upper), per_word(_ALPHA[data]), per_word(_MARK[data])
    length = per_word((data & 0xC0) != 0x80)
    first_upper = upper[starts] | ((ends - starts > 1) & upper[np.minimum(starts + 1, len(data) - 1)] & (data[starts] == 0xC3))
    doc = np.repeat(np.arange(n_docs), counts)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    shouted = (n_alpha >= 2) & (n_upper == n_alpha)
    case = np.select([n_alpha == 0, n_upper == 0, shouted, first_upper & (n_upper == 1)], [0, 1, 3, 2], 4)
    last = _LAST[data[ends - 1]]
    size = np.searchsorted([2, 4, 7, 11], length, "right")
    shape = (((case * 6 + last) * 5 + size) * 2 + (n_mark >= 2)) * 2 + same

    def mean(x: np.ndarray, over: np.ndarray | None = None) -> np.ndarray:
        below = np.bincount(doc, over, n_docs) if over is not None else counts
        return np.bincount(doc, x, n_docs) / np.maximum(below, 1)

    no_letters = (n_alpha == 0) & ~_DIGIT[data[starts]] & ~_DIGIT[data[ends - 1]]
    rates = [mean(n_upper, n_alpha), mean(n_mark, length), mean(same), mean(no_letters), mean(shouted), mean(last == 3), mean(n_mark >= 2), mean((last != 1) & (last != 2))]
    return Words(counts, shape, np.stack(rates, axis=1))


def votes(words: Words) -> np.ndarray:
    """Documents x labellers: BAD, NONE or GOOD; a document without words gets no votes."""
    bad, good = (np.array([x[k] for x in LABELLERS]) for k in (1, 2))
    out = np.where(words.rates > bad, BAD, np.where(words.rates < good, GOOD, NONE))
    out[words.counts == 0] = NONE
    return out


def hashed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each word and of each word with the one before (or the document's start), and its document."""
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    before = np.full(len(doc), 600, np.int64)
    before[1:] = np.where(doc[1:] == doc[:-1], words.shape[:-1], 600)
    both = np.concatenate([words.shape, (before + 1) * 601 + words.shape])
    return (mixed(both.astype(U64)) % U64(FEATURES)).astype(np.int64), np.concatenate([doc, doc])


def vote_rows(docs: DataFrame, id_col: str, text_col: str, share: float) -> DataFrame:
    """(id, pattern, features): votes as digits; of sampled documents the feature counts, as pairs of int32."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = int(share * 2**63)
        for batch in it:
            patterns, features, keys = [], [], batch.column(2).to_numpy()
            for first, end, data, offsets in runs(batch.column(1)):
                words = read_words(data, offsets)
                patterns += ["".join(map(str, v)) for v in votes(words).tolist()]
                chosen = (keys[first:end] & (2**63 - 1)) < limit
                index, doc = hashed(words)
                order = np.argsort(doc, kind="stable")
                ends = np.cumsum(2 * words.counts)
                for d, (b, e) in enumerate(zip(ends - 2 * words.counts, ends, strict=True)):
                    if chosen[d] and e > b:
                        features.append(np.stack(np.unique(index[order[b:e]], return_counts=True), axis=1).astype(np.int32).tobytes())
                    else:
                        features.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns, pa.string()), pa.array(features, pa.binary())], names=["id", "pattern", "features"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    return rows.mapInArrow(batches, "id bigint, pattern string, features binary")


@dataclass
class LabelModel:
    """Weights of the classes, good first and then a kind of bad per labeller, and each labeller's votes on
    documents of each: likely[class, labeller, vote]."""

    weights: np.ndarray
    likely: np.ndarray

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """P(class | pattern), classes x patterns."""
        at = np.arange(patterns.shape[1])
        log = np.log(self.likely)[:, at, patterns].sum(2) + np.log(self.weights)[:, None]
        part = np.exp(log - log.max(0))
        return part / part.sum(0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | pattern)."""
        return self.classes(patterns)[0]

    def accuracies(self) -> np.ndarray:
        """Labellers x (chance of a bad vote on a bad document, of a good vote on a good one)."""
        bad = self.weights[1:] / self.weights[1:].sum()
        return np.stack([bad @ self.likely[1:, :, BAD], self.likely[0, :, GOOD]], axis=1)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM over distinct vote patterns (rows of votes) and how often each occurs.

    Votes are independent given the class, and bad documents come in kinds, as labellers look for different
    faults: with one bad class, faults that never meet would fall to whichever class they disturb less. It starts
    from the belief that a bad vote is mostly right and that its document is of its labeller's kind.
    """
    bad = patterns == BAD
    n_bad = bad.sum(1, keepdims=True)
    good = np.where(n_bad > 0, 0.05, 0.95)
    part = np.concatenate([good, (1 - good) * np.where(n_bad > 0, bad / np.maximum(n_bad, 1), 1 / patterns.shape[1])], axis=1).T
    model = None
    for _ in range(rounds):
        mass = part * counts
        likely = np.stack([mass @ (patterns == v) for v in (BAD, NONE, GOOD)], axis=2) + 0.1
        weights = mass.sum(1) + 0.1
        model = LabelModel(weights / weights.sum(), likely / likely.sum(2, keepdims=True))
        new = model.classes(patterns)
        if np.abs(new - part).max() < 1e-6:
            break
        part = new
    return model


def fit_scorer(features: list[bytes], target: np.ndarray, rounds: int = 150, rate: float = 2.0, decay: float = 1e-6) -> np.ndarray:
    """Weights of FEATURES and, last, the intercept: logistic regression on feature frequencies with soft targets."""
    parts = [np.frombuffer(f, np.int32).reshape(-1, 2) for f in features]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    pairs = np.concatenate(parts) if parts else np.zeros((0, 2), np.int32)
    value = pairs[:, 1] / np.maximum(np.bincount(row, pairs[:, 1], len(parts)), 1)[row]
    weights, seen = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    for _ in range(rounds if parts else 0):
        z = np.bincount(row, weights[pairs[:, 0]] * value, len(parts)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(parts)
        grad = np.append(np.bincount(pairs[:, 0], error[row] * value, FEATURES), error.sum()) + decay * weights
        seen += grad**2
        weights -= rate * grad / np.sqrt(seen)
    return weights


def scored(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of every document; without words the score is 0."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for _, _, data, offsets in runs(batch.column(1)):
                words = read_words(data, offsets)
                index, doc = hashed(words)
                z = np.bincount(doc, weights[index], len(words.counts)) / np.maximum(2 * words.counts, 1) + weights[-1]
                out.append(np.where(words.counts > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, "id bigint, score double")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray]:
    """The label model, from all documents' votes, and the scorer's weights, from a sample of about `sample`.

    What reaches the driver is bounded by the number of vote patterns (3 to the power of the labellers), by the
    sample and by about SAMPLE_BYTES. The sample follows hashes of the rows and so neither their order nor their partitions.
    """
    share = min(1.0, sample / max(1, docs.count()))
    rows = written(vote_rows(docs, id_col, text_col, share), "votes")
    found = rows.groupBy("pattern").count().orderBy("pattern").collect()
    if not found:
        n = len(LABELLERS)
        return LabelModel(np.full(n + 1, 1 / (n + 1)), np.full((n + 1, n, 3), 1 / 3)), np.zeros(FEATURES + 1)
    table = np.array([[int(c) for c in r["pattern"]] for r in found])
    model = fit_label_model(table, np.array([r["count"] for r in found], float))
    posterior = dict(zip((r["pattern"] for r in found), model.posterior(table).tolist(), strict=True))
    chosen = rows.where("features IS NOT NULL")
    size = chosen.agg(F.sum(F.length("features")).alias("n")).first()["n"] or 0
    if size > SAMPLE_BYTES:
        chosen = chosen.where(F.pmod(F.xxhash64("id", "features"), F.lit(1 << 30)) < (SAMPLE_BYTES << 30) // size)
    chosen = chosen.orderBy("id", F.xxhash64("features")).select("pattern", "features").toPandas()
    target = np.array([posterior[p] for p in chosen["pattern"]])
    return model, fit_scorer(list(chosen["features"]), target)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: id, score (0 to 1, higher is better) and kept (score >= threshold).

    Null, empty and blank texts score 0 and are not kept; repeated rows score alike; an empty table gives no rows.
    Only the id and the text are read.
    """
    _, weights = train(docs, id_col, text_col, sample)
    return scored(docs, weights, id_col, text_col).select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents that the scorer rejects, all columns kept. Rows are judged in place, by their
    own text, so ids may repeat or be null."""
    _, weights = train(docs, id_col, text_col, sample)
    schema, at = docs.schema, docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            good = []
            for _, _, data, offsets in runs(batch.column(at)):
                words = read_words(data, offsets)
                index, doc = hashed(words)
                z = np.bincount(doc, weights[index], len(words.counts)) / np.maximum(2 * words.counts, 1) + weights[-1]
                good.append((words.counts > 0) & (1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold))
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(batches, schema)
