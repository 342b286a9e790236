"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a document's bytes, lower-cased in A-Z and spaces included, from both ends and labels every one of
them with language probabilities; a document's are the mean over the bytes of its letters. So that a document of any
length is read in parallel, its bytes are labelled in pieces of PIECE, each read from CONTEXT bytes before it to
CONTEXT bytes behind it: the state that enters a piece is that of these bytes. The network is trained by
backpropagation through time, in numpy, on a bounded sample of such pieces from all labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, U64, mixed, runs
from .shared import written

#: State size, bytes that a piece labels, bytes read before and behind it, and pieces in a matrix.
HIDDEN, PIECE, CONTEXT, BATCH = 8, 256, 32, 1024
#: About how many pieces of each language train the network, rows (document, piece), each as likely as any other, and
#: of all languages together: with more than their quotient of languages, each gives fewer.
SAMPLE, SAMPLE_ALL = 2_000, 200_000
#: Training steps, their rate, the pieces in a step, and bytes of a stretch of one that a step reads.
STEPS, RATE, PER_STEP, STRETCH = 300, 0.02, 160, 48
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[0x80:] = False


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Per direction: an input table (a row per byte), recurrent weights; then a layer from both states to languages."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng, n = np.random.default_rng(seed), len(languages)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
        self.p = {f"{k}{d}": draw(*shape) for d in "fb" for k, shape in (("x", (256, 3 * hidden)), ("u", (hidden, 3 * hidden)), ("v", (hidden, n)))}
        self.p["c"] = np.zeros(n, np.float32)

    def states(self, words: np.ndarray, keep: list | None = None, way: str = "f") -> np.ndarray:
        """States (steps, words, hidden) over bytes (words, steps), in reading order; `keep` gets what training needs."""
        h, (n_words, steps), x, u = self.hidden, words.shape, self.p["x" + way], self.p["u" + way]
        out = np.empty((steps, n_words, h), np.float32)
        state = np.zeros((n_words, h), np.float32)
        for t in range(steps):
            given, own = x[words[:, t]], state @ u
            gates = given[:, : 2 * h]
            gates += own[:, : 2 * h]
            np.clip(gates, -30, 30, out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            reset, stay = gates[:, :h], gates[:, h:]
            new = np.tanh(given[:, 2 * h :] + reset * own[:, 2 * h :])
            if keep is not None:
                keep.append((state, reset.copy(), stay.copy(), new, own[:, 2 * h :].copy()))
            state = new + stay * (state - new)
            out[t] = state
        return out

    def turned(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each place of the words read from the end, the place in reading order from the front, padding last."""
        at = lengths[:, None] - 1 - np.arange(words.shape[1])
        return np.where(at >= 0, at, np.arange(words.shape[1]))

    def read(self, words: np.ndarray, lengths: np.ndarray, way: str) -> np.ndarray:
        """States (steps, hidden, words), at each byte of words (steps, words) of rising lengths, without what training
        keeps; `b` begins at each word's end. Half-scaled tanh gates are the logistic ones."""
        h, scale = self.hidden, np.repeat(np.float32([0.5, 0.5, 1.0]), self.hidden)[:, None]
        x, u = (np.ascontiguousarray(self.p[k + way].T * scale) for k in "xu")
        steps, n = words.shape
        out, state = np.zeros((steps, h, n), np.float32), np.zeros((h, n), np.float32)
        for t in range(steps) if way == "f" else reversed(range(steps)):
            ended = int(np.searchsorted(lengths, t, "right"))
            given, own = np.take(x, words[t, ended:], axis=1), u @ state[:, ended:]
            gates = given[: 2 * h]
            gates += own[: 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= np.float32(0.5)
            new = own[2 * h :]
            new *= gates[:h]
            new += given[2 * h :]
            np.tanh(new, out=new)
            now = state[:, ended:]
            now -= new
            now *= gates[h:]
            now += new
            out[t, :, ended:] = now
        return out

    def probabilities(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(steps, languages, words): a distribution at every byte of words (words, steps) of rising lengths."""
        words = np.ascontiguousarray(words.T)
        z = self.p["vf"].T @ self.read(words, lengths, "f")
        z += self.p["vb"].T @ self.read(words, lengths, "b")
        z += self.p["c"][:, None]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def gradients(self, words: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes of the words against each word's language, and its gradients."""
        turn, rows = self.turned(words, lengths), np.arange(len(words))[:, None]
        kept = {"f": [], "b": []}
        ahead = self.states(words, kept["f"], "f").transpose(1, 0, 2)
        back = self.states(words[rows, turn], kept["b"], "b").transpose(1, 0, 2)
        z = ahead @ self.p["vf"] + back[rows, turn] @ self.p["vb"] + self.p["c"]
        z = np.exp(z - z.max(2, keepdims=True))
        z /= z.sum(2, keepdims=True)
        inside = np.arange(words.shape[1]) < lengths[:, None]
        total = inside.sum()
        loss = float(-np.log(z[rows, np.arange(words.shape[1]), target[:, None]] + 1e-9)[inside].sum() / total)
        dz = z
        dz[rows, np.arange(words.shape[1]), target[:, None]] -= 1
        dz *= (inside / np.float32(total))[:, :, None]
        flat = dz.reshape(-1, dz.shape[2])
        grads = {"c": flat.sum(0), "vf": ahead.reshape(-1, self.hidden).T @ flat}
        dz_back = dz[rows, turn]
        grads["vb"] = back.reshape(-1, self.hidden).T @ dz_back.reshape(flat.shape)
        for way, d, read in (("f", dz, words), ("b", dz_back, words[rows, turn])):
            grads["x" + way], grads["u" + way] = self._through_time(kept[way], d @ self.p["v" + way].T, read, self.p["u" + way])
        return loss, grads

    def _through_time(self, kept: list, d_out: np.ndarray, words: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.hidden
        d_state, d_u = np.zeros(d_out[:, 0].shape, np.float32), np.zeros_like(u)
        d_x = np.empty((len(kept), len(words), 3 * h), np.float32)
        for t in reversed(range(len(kept))):
            before, reset, stay, new, own = kept[t]
            d = d_state + d_out[:, t]
            d_new = d * (1 - stay) * (1 - new**2)
            d_stay = d * (before - new) * stay * (1 - stay)
            d_reset = d_new * own * reset * (1 - reset)
            d_x[t] = np.concatenate([d_reset, d_stay, d_new], 1)
            d_own = np.concatenate([d_reset, d_stay, d_new * reset], 1)
            d_u += before.T @ d_own
            d_state = d * stay + d_own @ u.T
        flat, order = words.T.ravel(), np.argsort(words.T.ravel(), kind="stable")
        seen, first = np.unique(flat[order], return_index=True)
        table = np.zeros((256, 3 * h), np.float32)
        table[seen] = np.add.reduceat(d_x.reshape(-1, 3 * h)[order], first)
        return table, d_u

    def train(self, pieces: list[np.ndarray], target: np.ndarray, steps: int = STEPS, rate: float = RATE, size: int = PER_STEP) -> list[float]:
        """Adam over seeded batches, with as many stretches of each language; the losses, step by step."""
        rng, losses = np.random.default_rng(5), []
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in "mv")
        own = [np.flatnonzero(target == k) for k in np.unique(target)]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(x, -(-size // len(own))) for x in own])
            lengths = np.array([min(len(pieces[i]), STRETCH) for i in pick])
            words = np.zeros((len(pick), lengths.max()), np.uint8)
            for row, i, n in zip(words, pick, lengths, strict=True):
                at = rng.integers(0, len(pieces[i]) - n + 1)
                row[:n] = pieces[i][at : at + n]
            loss, grads = self.gradients(words, lengths, target[pick])
            losses.append(loss)
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                scale = rate * min(1.0, 2 * (1 - (step - 1) / steps))
                self.p[k] -= (scale * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, languages): mean probabilities over the bytes of letters; zero without any."""
        n_docs, n_langs = len(offsets) - 1, len(self.languages)
        doc, start, end = piece_bounds(offsets)
        low, high = np.maximum(start - CONTEXT, offsets[doc]), np.minimum(end + CONTEXT, offsets[doc + 1])
        lower, letter, length = LOWER[data], _LETTER[data], high - low
        sums = np.zeros((n_langs + 1, n_docs))
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            size = length[pick]
            place = low[pick, None] + np.arange(size[-1])
            inside = place < high[pick, None]
            place = np.minimum(place, len(data) - 1)
            weight = letter[place] & inside & (place >= start[pick, None]) & (place < end[pick, None])
            mass = np.einsum("slw,ws->lw", self.probabilities(np.where(inside, lower[place], 0), size), weight.astype(np.float32))
            for total, part in zip(sums, [*mass, weight.sum(1)], strict=True):
                total += np.bincount(doc[pick], part, n_docs)
        return (sums[:-1] / np.maximum(sums[-1], 1)).T


def piece_bounds(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and end byte of each piece of the documents of a run."""
    n = -(-np.diff(offsets) // PIECE)
    doc = np.repeat(np.arange(len(n)), n)
    start = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
    return doc, start, np.minimum(start + PIECE, offsets[doc + 1])


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def training_pieces(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, id, piece): about SAMPLE pieces per language, and SAMPLE_ALL of all, from all over the texts that may teach.

    Pieces are chosen by a hash of the id and their number, at a rate that the size of their language's texts sets;
    only languages with more pieces than their part need one of their own.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(~held_out(F.col(id_col)), F.lit(False)))
    rows = known.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = written(rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / PIECE)).alias("n")), "sizes")
    languages = max(1, sizes.count())
    part, thin = max(1, min(SAMPLE, SAMPLE_ALL // languages)), min(1.0, SAMPLE_ALL / languages)
    share = {r["lang"]: thin * part / r["n"] for r in sizes.where(F.col("n") > part).collect()}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            langs, ids, out = batch.column(0).to_pylist(), batch.column(1).to_numpy(), [[], [], []]
            for first, _, data, offsets in runs(batch.column(2)):
                doc, start, end = piece_bounds(offsets)
                below = np.array([share.get(x, thin) for x in langs[first : first + len(offsets) - 1]])[doc]
                draw = mixed(mixed(ids[first + doc].astype(U64)) ^ (start - offsets[doc]).astype(U64)) >> U64(11)
                for k in np.flatnonzero(draw < below * 2.0**53):
                    for column, value in zip(out, (langs[first + doc[k]], ids[first + doc[k]], data[start[k] : end[k]].tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["lang", "id", "piece"])

    return rows.mapInArrow(batches, "lang string, id bigint, piece binary")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network, from documents that are not held out; None if none of them names a language."""
    rows = training_pieces(docs, id_col, text_col, lang_col).toPandas().sort_values(["lang", "id", "piece"], kind="stable")
    rows = rows[[bool(_LETTER[np.frombuffer(x, np.uint8)].any()) for x in rows["piece"]]]
    if not len(rows):
        return None
    languages = sorted(set(rows["lang"]))
    network = Network(languages)
    network.train([LOWER[np.frombuffer(x, np.uint8)] for x in rows["piece"]], np.array([languages.index(x) for x in rows["lang"]]))
    return network


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: id, held_out, lang_pred, score.

    held_out rows (crc32 of the id as text, modulo 4, is 2) never teach; a null id is not held out and never
    teaches. lang_pred is a learned language, or `und` with score 0 where the text is null or has no letter, or
    nothing could be learnt. Ties go to the first language by name. Predictions use the text alone. An empty table
    gives no rows.
    """
    network = train(docs, id_col, text_col, lang_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            langs, scores = [], []
            for first, end, data, offsets in runs(batch.column(1)):
                letters = np.add.reduceat(np.append(_ASCII_LETTER[data], False).astype(np.int64), offsets[:-1]) if len(data) else np.zeros(end - first, int)
                letters[np.diff(offsets) == 0] = 0
                pooled = network.pooled(data, offsets) if network is not None else np.zeros((end - first, 1))
                best = pooled.argmax(1)
                for d in range(end - first):
                    known = network is not None and (letters[d] > 0 or any(map(str.isalpha, data[offsets[d] : offsets[d + 1]].tobytes().decode())))
                    langs.append(network.languages[best[d]] if known else UNKNOWN)
                    scores.append(float(min(1.0, pooled[d, best[d]])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(batches, "id bigint, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
