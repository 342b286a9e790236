"""Each operator against brute force, an exact round trip or held-out accuracy, and on the awkward inputs."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from millrace.llm import chat_format, decontaminate, divergence, exact_dedup, graph, kernels, language, mixing, near_dedup, ngram_join, quality, queries, secret_scan, shared, substring_dedup, token_count, turn_repair

from ..conftest import SF, rows

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "The quick brown fox jumps over the lazy dog while seven wizards watch from the old stone bridge near town"


def docs_of(spark, texts, start=0, extra=()):
    given = [(start + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*given, *extra], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, an id that names two texts, a null id."""
    words = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    texts = [None, "", " \t\n", LONG, LONG, LONG.replace(" ", "  "), "one", "one two", words, words + " end", "ÜÉß 🎉 日本", "a" * 5_000]
    return docs_of(spark, texts, extra=[(3, LONG, None, None, 1), (3, "another text under the same id", "de", "src0", 5), (None, LONG, "en", "src1", 2)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def on_table(df, name, sql):
    """What DuckDB says of `sql` where the table `name` is df."""
    import duckdb

    connection = duckdb.connect()
    connection.register(name, df.toArrow())
    return connection.sql(sql).df()


def clashing(df):
    """Columns named like those that operators make."""
    names = ["_row", "copy", "copies", "key", "n_shingles", "component_id", "_kept_id", "_near_id", "_leak_id", "id", "digest", "at", "keep", "n", "row", "token", "component", "kept", "tag", "doc", "spans", "text_sha256", "window", "size", "start", "tokens", "domain", "epoch", "budget", "score", "norm", "share"]
    return df.withColumns({c: F.lit("clash") for c in names if c not in df.columns})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_entry_lists_every_operator_and_the_pipeline():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert len(names) == 14 and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mixing"]


# 1 chat formatting


def formatted(spark, events):
    df = spark.createDataFrame(events, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string")
    out = defaultdict(list)
    for r in chat_format.format_conversations(df).orderBy("conv_id", "part").collect():
        out[r["conv_id"]].append(r)
    return {k: "".join(r["text"] for r in v) for k, v in out.items()}, out


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "open", "user", "Hi"), (1, 1, 0, "delta", None, " there"), (1, 2, 0, "edit", None, "Hello"), (1, 3, 1, "open", "assistant", ""),
        (1, 4, 1, "delta", None, "bad"), (1, 5, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "od"), (1, 6, 1, "delta", None, "go"), (2, 0, 0, "delta", "user", "stray"),
    ]
    text, blocks = formatted(spark, events)
    assert list(chat_format.read_back(text[1])) == [("user", "Hello"), ("assistant", "good")]
    assert list(chat_format.read_back(text[2])) == [("user", "stray")]
    assert [r["text"][a:b] for r in blocks[1] for a, b in r["mask"]] == ["good"]


@pytest.mark.parametrize("text", ["<|im_end|>", "\\", "\\|", "<\\|", "<|<|\\\\|", "a\nb", "<", "|>", "", "🎉<|im_start|>x\n"])
def test_escaping_round_trip(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    piece, span = chat_format.render(text, text, True)
    assert list(chat_format.read_back(piece)) == [(text, text)] and chat_format.unescape(piece[slice(*span)]) == text


def test_long_conversation_is_spread_and_joined(spark):
    events = [(7, i, i, "open", "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(400)]
    text, blocks = formatted(spark, events)
    assert len(blocks[7]) > 1
    assert [t for _, t in chat_format.read_back(text[7])] == [f"text {i}" for i in range(400)]


def test_messages_stand_by_their_first_sequence(spark):
    text, _ = formatted(spark, [(1, 0, 9, "open", "user", "first"), (1, 1, 2, "open", "assistant", "sec"), (1, 2, 9, "delta", None, " still"), (1, 3, 2, "delta", None, "ond")])
    assert list(chat_format.read_back(text[1])) == [("user", "first still"), ("assistant", "second")]


def test_turns_survive_their_log(spark):
    text = "x" * 100_000 + "<|im_end|>" + "é" * 7
    turns = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate([("user", "question"), ("assistant", text), ("system", None), ("assistant", "a"), ("user", ""), (None, "<|x")])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    log = clashing(queries.turn_log(df))
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    got = chat_format.digest(chat_format.format_conversations(log)).collect()
    want = hashlib.sha256("".join(f"{r or ''}\n{x or ''}\n" for c, _, r, x in turns if c == 0).encode()).hexdigest()
    assert len(got) == 3 and {(r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in got} == {(6, want, len(text) + 1)}


def test_tied_repeated_and_turnless_rows_stay_apart(spark, duck):
    turns = [
        (1, 0, "user", "hello world"), (1, 0, "user", "hello world"), (1, 1, "assistant", "yes it is"), (1, 1, "assistant", "yes it is"),
        (2, 0, "system", "prompt"), (2, 0, "user", "question"), (2, 1, "assistant", "a"), (2, 1, "assistant", ""), (2, 1, None, None),
        (3, None, "user", "hello world"), (3, None, "assistant", "answer!!"), (3, None, "user", None), (3, 4, "user", "last"), (3, 1, "assistant", "x" * 5_000),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat_format.digest(chat_format.format_conversations(queries.turn_log(clashing(df)))).toPandas()
    want = on_table(df, "conversations", queries.oracle_sql()["op1_chat_format"]).query("conv_id >= 0")
    assert rows(got) == rows(want)


def test_conversation_nulls_and_ties(spark):
    rows_ = [(None, 0, 0, "open", None, None), (1, None, None, "open", "user", "b"), (1, None, None, "open", "user", "a"), (1, None, None, "open", "user", "a")]
    text, _ = formatted(spark, rows_)
    assert list(chat_format.read_back(text[1])) == [("user", "a"), ("user", "a"), ("user", "b")]
    assert list(chat_format.read_back(text[None])) == [("", "")]
    empty = spark.createDataFrame([], "conv_id bigint, seq bigint, message bigint, kind string, role string, text string")
    assert chat_format.digest(chat_format.format_conversations(empty)).count() == 0


# 2 token counts


def test_tokens_equal_the_library(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in queries.op2_count_tokens(spark, SF).collect()}
    for i, doc in documents.items():
        n = len(library.encode(doc["text"] or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["over_limit"], got[i]["n_bytes"]) == (n, n > 1024, len((doc["text"] or "").encode()))


def test_tokens_of_awkward_texts(spark, awkward, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "aaaa" * 500, "  x\n\n y's 12345 it're", "日本語🎉🎉", "\x00\x1c\x85   x", " a  b", "a \n b  c　 d", "²½ⅷ ",
             "".join(chr(i) for i in range(1, 0x250)), " ".join(map(chr, range(0x300, 0x600)))]
    counter = token_count.Counter(token_count.Merges(path))
    assert counter.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_count.count_tokens(clashing(awkward), path, 1024).count() == awkward.count()
    assert token_count.count_tokens(none, path, 1024).count() == 0


# 3 quality classifier


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"byte_fallback": True}}, {"model": {"dropout": 0.1}}])
def test_unlike_tokenizers_are_refused(tmp_path, change):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for key, value in change.items():
        spec[key] = spec[key] | value if key == "model" else value
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="not supported"):
        token_count.Merges(str(tmp_path / "t.json"))


def test_quality_agrees_with_held_labels(spark):
    got = queries.op3_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert ((both["kept"]) == (both["quality"] == 1)).mean() > 0.97
    assert both[both["quality"] == 1]["kept"].mean() > 0.99


def test_the_training_sample_is_bounded_by_its_features(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = quality.train(docs)[1]
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 40_000)
    thin, again = quality.train(docs)[1], quality.train(docs.repartition(3))[1]
    assert not np.allclose(whole, thin) and np.allclose(thin, again)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    n, skill = 20_000, np.array([0.95, 0.9, 0.85, 0.8])
    good = rng.random(n) < 0.8
    bad_kind = rng.integers(0, 4, n)
    votes = np.full((n, len(quality.LABELLERS)), quality.NONE)
    for k, s in enumerate(skill):
        right = rng.random(n) < s
        votes[:, k] = np.where(good, np.where(rng.random(n) < 0.005, quality.BAD, np.where(right, quality.GOOD, quality.NONE)), np.where((bad_kind == k) & right, quality.BAD, quality.NONE))
    table, inverse = np.unique(votes, axis=0, return_inverse=True)
    model = quality.fit_label_model(table, np.bincount(inverse.ravel()).astype(float))
    guess = model.posterior(table)[inverse.ravel()] > 0.5
    assert (guess == good).mean() > 0.95
    assert np.abs(model.accuracies()[:4, 1] - skill).max() < 0.05


def plain_em(patterns, counts, rounds):
    """The label model's EM, document kind by document kind, in plain loops."""
    n = len(patterns[0])
    part = []
    for p in patterns:
        bad = [k for k, v in enumerate(p) if v == quality.BAD]
        good = 0.05 if bad else 0.95
        part.append([good] + [(1 - good) * ((k in bad) / len(bad) if bad else 1 / n) for k in range(n)])
    for _ in range(rounds):
        weights = [sum(c * q[z] for c, q in zip(counts, part, strict=True)) + 0.1 for z in range(n + 1)]
        likely = [[[sum(c * q[z] for c, q, p in zip(counts, part, patterns, strict=True) if p[k] == v) + 0.1 for v in (quality.BAD, quality.NONE, quality.GOOD)] for k in range(n)] for z in range(n + 1)]
        likely = [[[x / sum(votes_) for x in votes_] for votes_ in of] for of in likely]
        part = []
        for p in patterns:
            odds = [weights[z] * math.prod(likely[z][k][v] for k, v in enumerate(p)) for z in range(n + 1)]
            part.append([x / sum(odds) for x in odds])
    return [q[0] for q in part]


def test_label_model_equals_plain_em():
    rng = np.random.default_rng(6)
    table = np.unique(rng.choice([quality.BAD, quality.NONE, quality.GOOD], (40, 5), p=[0.2, 0.3, 0.5]), axis=0)
    counts = rng.integers(1, 50, len(table)).astype(float)
    for rounds in (1, 2, 7):
        assert np.allclose(quality.fit_label_model(table, counts, rounds).posterior(table), plain_em(table.tolist(), counts.tolist(), rounds), atol=1e-9)


def test_scorer_equals_plain_gradient_steps():
    rng = np.random.default_rng(8)
    docs = [{int(f): int(c) for f, c in zip(rng.choice(50, 6, replace=False), rng.integers(1, 5, 6), strict=True)} for _ in range(12)]
    target = rng.random(12)
    weights, seen, offset, offset_seen = defaultdict(float), defaultdict(lambda: 1e-8), 0.0, 1e-8
    for _ in range(20):
        errors = []
        for d, t in zip(docs, target, strict=True):
            z = sum(weights[f] * c for f, c in d.items()) / sum(d.values()) + offset
            errors.append((1 / (1 + math.exp(-z)) - t) / len(docs))
        grad = {f: sum(e * d.get(f, 0) / sum(d.values()) for e, d in zip(errors, docs, strict=True)) + 1e-6 * weights[f] for f in range(50)}
        g = sum(errors) + 1e-6 * offset
        for f in range(50):
            seen[f] += grad[f] ** 2
            weights[f] -= 2.0 * grad[f] / seen[f] ** 0.5
        offset_seen += g**2
        offset -= 2.0 * g / offset_seen**0.5
    made = quality.fit_scorer([np.array(sorted(d.items()), np.int32).tobytes() for d in docs], target, 20)
    assert np.allclose(made[:50], [weights[f] for f in range(50)], atol=1e-9) and abs(made[-1] - offset) < 1e-9 and not made[50:-1].any()


def test_quality_of_awkward_texts(spark, awkward, none):
    got = {(r["doc_id"], i): r for i, r in enumerate(quality.classify(clashing(awkward)).collect())}
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert [r["kept"] for (i, _), r in got.items() if i in (0, 1, 2)] == [False] * 3
    assert quality.classify(none).count() == 0 and quality.keep_good(none).count() == 0
    assert quality.keep_good(clashing(awkward)).columns == clashing(awkward).columns


# 4 mixing


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 10), ("a", "en", "y", 1000), ("b", "en", "z", 1000)], "domain string, lang string, source string, tokens bigint")
    out = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, {}, F.lit(400), 1).collect()}
    assert out == {"x": 10, "y": 190, "z": 200}  # what x lacks stays in a
    leaves = spark.createDataFrame([("a", "en", "x", 10), ("a", "en", "y", 50), ("b", "en", "z", 1000)], "domain string, lang string, source string, tokens bigint")
    out = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, {}, F.lit(400), 1).collect()}
    assert out == {"x": 10, "y": 50, "z": 340}  # all of a is full, so b has the rest


def poured(caps: dict, weights: dict, pool: int) -> dict:
    """Budgets by pouring: share by weight, fill those that reach their cap, share what is left again."""
    out, left = {}, dict(caps)
    while left:
        total = sum(weights[k] for k in left)
        full = [k for k, cap in left.items() if cap * total <= weights[k] * pool]
        if not full:
            return out | {k: pool * weights[k] // total for k in left}
        for k in full:
            out[k], pool = left.pop(k), pool - caps[k]
    return out


def test_budgets_equal_pouring(spark):
    rng = np.random.default_rng(12)
    for max_epochs in (1, 3):
        given = {(f"d{d}", f"l{k}", f"s{s}"): int(rng.integers(1, 10 ** rng.integers(1, 6))) for d in range(3) for k in range(4) for s in range(5) if rng.random() < 0.8}
        weight_of = {level: {f"{level[0]}{i}": int(rng.integers(0, 6)) for i in range(4)} for level in mixing.LEVELS}
        of = lambda level, value: weight_of[level].get(value, 1)
        used = {k: n * max_epochs for k, n in given.items() if all(of(x, v) for x, v in zip(mixing.LEVELS, k))}
        want, budgets = {}, {(): min(sum(given.values()) // 2, sum(used.values()))}
        for depth, level in enumerate(mixing.LEVELS):
            below = {}
            for parent, pool in budgets.items():
                caps = Counter()
                for k, n in used.items():
                    if k[:depth] == parent:
                        caps[k[: depth + 1]] += n
                below |= poured(dict(caps), {k: of(level, k[-1]) for k in caps}, pool)
            want = budgets = below
        leaves = spark.createDataFrame([(*k, n) for k, n in given.items()], "domain string, lang string, source string, tokens bigint")
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.leaf_budgets(leaves, weight_of, F.expr("sum(tokens) div 2"), max_epochs).collect()}
        assert got == want
    with pytest.raises(ValueError):
        mixing.leaf_budgets(leaves, {"lang": {"en": -1}}, F.lit(1), 1)


def test_mix_fills_budgets_by_epochs(spark):
    docs = docs_of(spark, [f"{'w ' * (1 + i % 7)}" for i in range(300)])
    out = mixing.mix(docs, {"source": {"src0": 8}}, F.lit(2200), queries.words(F.col("text")), F.lit("d"), 1, 4).toPandas()
    for _, leaf in out.groupby("source"):
        assert leaf["budget"].iloc[0] <= leaf["tokens"].sum() < leaf["budget"].iloc[0] + 7
        full = leaf["epoch"].max()
        assert all((leaf["epoch"] == e).sum() == 100 for e in range(full))
    assert not out.duplicated(["doc_id", "epoch"]).any()


def test_mixing_awkward_texts(spark, awkward, none):
    out = mixing.mix(clashing(awkward).drop("tokens", "domain"), {}, F.expr("sum(tokens)"), queries.words(F.col("text")), queries.domain(F.col("source")))
    assert out.where("doc_id IN (0, 1, 2)").count() == 0 and out.count() > 0
    assert mixing.mix(none, {}, F.expr("sum(tokens)"), queries.words(F.col("text")), F.lit("d")).count() == 0


# 5 benchmark decontamination


def contaminated(docs, items, percent=80):
    out = {}
    for item, text in items:
        n = len((text or "").split())
        for doc, whole in docs:
            words = (whole or "").encode().split()
            if n and len(words) >= n:
                best = max((decontaminate.weighted_similarity(b" ".join(words[k : k + n]).decode(), text), -k) for k in range(len(words) - n + 1))
                if 100 * best[0] >= percent:
                    out[doc, item] = (best[0], -best[1])
    return out


def test_contamination_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 4))
    items = [(i, " ".join(word() for _ in range(int(n)))) for i, n in enumerate([2, 5, 8, 12, 30, 60])]
    texts = []
    for i in range(80):
        words = [word() for _ in range(100)]
        item = items[i % len(items)][1].split()
        for _ in range(i // 20):
            item[rng.integers(0, len(item))] = word()
        at = rng.integers(0, 80)
        texts.append(" ".join(words[:at] + item + words[at:]).upper())
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == contaminated(list(enumerate(texts)), items)


def test_index_finds_all_within_the_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 2)
    prints = []
    for flips in range(0, decontaminate.RADIUS + 4):
        bits = np.unpackbits(base.view(np.uint8))
        bits[rng.choice(128, flips, replace=False)] ^= 1
        prints.append((5, *np.packbits(bits).view(np.int64).tolist()))
    items = spark.createDataFrame([(1, 5, *base.tolist())], "item_id bigint, size bigint, g1 bigint, g2 bigint")
    found = decontaminate.within_radius(spark.createDataFrame(prints, "size bigint, f1 bigint, f2 bigint"), items).collect()
    assert {(r["f1"], r["f2"]) for r in found} == {p[1:] for p in prints[: decontaminate.RADIUS + 1]}


def test_windows_at_the_threshold_are_met_outside_the_radius(spark):
    """Windows that lack just as many shingles as they may, at places that spread what is lost: most lie outside the
    radius, and all are found. Unlike windows of one size do not meet each other's items."""
    items = [(k, " ".join(f"w{k}x{i}" for i in range(76))) for k in range(60)]  # 72 shingles, of which 8 may go
    texts = []
    for k, text in items:
        words = text.split()
        words[k % 66 + 2], words[-1] = "other", "end"  # five and one shingle: 66 of 78
        words[0] = "begin"
        texts.append(" ".join(words))
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontaminate.contamination(docs, bench).collect()}
    want = contaminated(list(enumerate(texts)), items)
    assert got == want and len(want) == 60 and min(s for s, _ in want.values()) < 0.85
    prints = decontaminate.item_prints(docs.selectExpr("doc_id AS item_id", "text")).selectExpr("size", "g1 AS f1", "g2 AS f2")
    near = decontaminate.within_radius(prints, decontaminate.item_prints(bench)).count()
    assert near < 60  # the index alone would lose some


def test_sql_of_contamination_knows_short_documents(spark):
    items = [(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(6)] + [(9, "two words")]
    texts = [" ".join(items[k][1].split()[: 30 - 2 * k]) for k in range(6)] + [items[0][1] + " " + items[1][1], "two", "two words", "", None]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    import duckdb

    connection = duckdb.connect()
    connection.register("documents", docs.toArrow())
    connection.register("benchmark", bench.toArrow())
    want = connection.sql(queries.oracle_sql()["op5_decontaminate"]).df()
    assert rows(decontaminate.contamination(docs, bench).toPandas()) == rows(want) and len(want) == 6


def test_contamination_of_awkward_texts(spark, awkward, none, monkeypatch):
    bench = spark.createDataFrame([(1, LONG), (2, None), (3, " "), (4, "one"), (5, LONG)], "item_id bigint, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(clashing(awkward), bench).collect()}
    assert hits == {(d, i) for d in (3, 4, 5, None) for i in (1, 5)} | {(6, 4), (7, 4)}
    monkeypatch.setattr(decontaminate, "WORDS_PER_PASS", 20)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(awkward, bench).collect()} == hits
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.decontaminate(awkward, bench.where("false")).count() == awkward.count()


def test_a_passage_of_very_many_documents_is_dealt_over_copies(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_PER_COPY", 10)
    passage, item = " ".join(f"w{i}" for i in range(40)), spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    docs = docs_of(spark, [f"before {i} {passage} after {i}" if i % 2 else f"clean {i} " * 30 for i in range(400)])
    found = decontaminate.contamination(docs, item).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(1, 400, 2)) and {(r["item_id"], r["similarity"], r["start_word"]) for r in found} == {(7, 1.0, 2)}


def test_documents_shorter_than_an_item(spark):
    items = [(k, " ".join(f"w{k}x{i}" for i in range(40))) for k in range(20)]
    texts = [" ".join(items[k][1].split()[k % 3 : 40 - cut]).upper() for k, cut in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 12, 36] * 2)]
    texts += ["w0x0", "", " ".join(items[0][1].split()[:20] + ["x"] + items[0][1].split()[20:38])]
    want = {}
    for d, text in enumerate(texts):
        n = len(text.split())
        for i, item in items if 0 < n < 40 else ():
            score = decontaminate.weighted_similarity(text, item)
            if 100 * score >= 80:
                want[d, i] = (score, 0, n, 1)
    assert (0, 0) in want and 5 < len(want) < 20
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"], r["n_words"], r["n_windows"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == want


def test_clean_rows_stay_beside_a_leak_of_the_same_id(spark):
    given = [(None, LONG), (None, "clean without id"), (None, None), (1, f"before {LONG}"), (1, "clean under the same id"), (2, "clean")]
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert Counter(map(tuple, left.collect())) == Counter(g for g in given if LONG not in (g[1] or ""))


# 6 repeated substrings


def removed(docs):
    """id -> (bytes, removed, spans, digest) by a set of all strings of smaller documents."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone, own = bytearray(len(raw)), set()
        for p in range(len(raw) - 49):
            own.add(raw[p : p + 50])
            if raw[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
        seen |= own
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def cut(df):
    out = substring_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return {r[0]: tuple(r[1:]) for r in out}


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_substrings_equal_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert cut(docs) == removed((i, r["text"]) for i, r in documents.items())


def test_substrings_of_small_alphabets(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SORTED", 100)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 200)
    rng = np.random.default_rng(3)
    texts = ["ab"[k % 2] * 120 for k in range(4)] + ["".join(rng.choice(["a", "b", "é"], 300, p=[0.9, 0.08, 0.02])) for _ in range(30)]
    texts += [texts[5][:49] + "x" + texts[5][49:99], texts[5][:50], texts[5][:49], "x" + texts[5][10:60] + "y"]
    assert cut(docs_of(spark, texts)) == removed(enumerate(texts))


def test_substrings_of_awkward_texts(spark, awkward, none):
    out = substring_dedup.remove_repeats(clashing(awkward)).collect()
    assert len(out) == awkward.count()
    by_id = defaultdict(list)
    for r in out:
        by_id[r["doc_id"]].append(r["n_removed"])
    assert by_id[4] == [len(LONG)] and sorted(by_id[3]) == [0, 0, 0] and by_id[None] == [0] and by_id[0] == [0]
    assert substring_dedup.remove_repeats(none).count() == 0


def test_every_window_is_in_one_block():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc "), n)) for n in (0, 49, 50, 51, 700, 50, 3)]
    data, offsets = kernels.string_bytes(pa.array(texts))
    _, _, doc, lo, n, rel = substring_dedup.anchors(data, offsets)
    covered = Counter(w for a, k in zip(lo, n) for w in range(a, a + k))
    assert covered == Counter(w for i in range(len(texts)) for w in range(offsets[i], offsets[i + 1] - 49))
    assert (rel + substring_dedup.LEAD <= 50).all() and (rel >= n - 1).all()


def test_multikey_order():
    rng = np.random.default_rng(5)
    keys, last = rng.integers(0, 3, (500, 4)).astype(np.uint64), rng.integers(0, 9, 500)
    order, new = substring_dedup.multikey_order(keys, last)
    want = sorted(range(500), key=lambda i: (*keys[i], last[i]))
    assert [(*keys[i], last[i]) for i in order] == [(*keys[i], last[i]) for i in want]
    assert new.sum() == len({tuple(k) for k in keys})


# 7 secret scans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_base_spans_equal_the_patterns(spark, documents):
    got = {r["doc_id"]: r for r in queries.op7_scan_secrets(spark, SF).collect()}
    assert len(got) == len(documents)
    for i, doc in documents.items():
        text = doc["text"] or ""
        found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def test_method_adds_formats_and_leaves_words_alone(spark):
    rng = np.random.default_rng(6)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(200)]
    keys = ["AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16)) for _ in range(200)]
    plain = ["extraordinarily-long-words", "internationalization2", "someFunctionName_with_parts", "path/to/some/file/here"]
    texts = [f"key {h} and {k} then {plain[i % 4]}" for i, (h, k) in enumerate(zip(hexes, keys))]
    texts += ["see BKIAQ3EGRZ7T5UVH2WX4 here", "internationalization2 path/to/some/file/here", "PASSWORD = 'abcdefghijkl'", "ſecret=abcdefghijkl token:short"]
    out = [r for r in secret_scan.digest(secret_scan.scan(docs_of(spark, texts))).orderBy("doc_id").collect()]
    assert all(r["n_access"] == 1 and r["n_hex"] == 1 for r in out[:200])
    assert [r["n_format"] for r in out[200:]] == [1, 0, 0, 0] and sum(r["n_format"] for r in out[:200]) == 0
    assert [r["n_assign"] for r in out[202:]] == [1, 0] and out[200]["spans"] == "format:4:24"


def test_credentials_without_a_digit_are_scored(spark):
    rng = np.random.default_rng(8)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    keys = ["".join(rng.choice(letters, 24)) for _ in range(230)]
    plain = ["extraordinarily-long-words", "internationalization", "incomprehensibilities", "path/to/some/file/here"]
    texts = [f"token={k} beside {plain[i % 4]}" for i, k in enumerate(keys[:200])] + [f"see {k} here" for k in keys[200:]] + plain
    out = secret_scan.digest(secret_scan.scan(docs_of(spark, texts))).orderBy("doc_id").collect()
    assert [r["spans"] for r in out[200:230]] == ["format:4:28"] * 30
    assert sum(r["n_format"] for r in [*out[:200], *out[230:]]) == 0


def test_held_out_formats_pass_and_base_spans_tell_their_margin(spark):
    """Formats of which the automata saw others, held against a plain scoring of every candidate."""
    rng = np.random.default_rng(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(list(letters), 40)) for _ in range(260)]
    around = [k[:12] + "".join(rng.choice(list("0123456789abcdef"), 16)) + k[28:] for k in keys[200:]]  # a hex span lies inside
    texts = [f"token = {k} beside some-long-hyphenated-words" for k in keys[:200]] + [f"see {k} here" for k in around] + ["k" * 700 + "=" + "long" * 99]
    docs = docs_of(spark, texts)
    automata, background = secret_scan.learn(docs)
    out = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).collect()}
    for i, text in enumerate(texts):
        base = secret_scan.base_spans(text)
        known = {(b - len(c), b) for _, b, _, c in base}
        ratio = lambda x: (max(a.score(x) for a in automata.values()) - background.score(x)) / len(x)
        runs = [m for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text) if m.span() not in known]
        want = [(a, b, k, ratio(c)) for a, b, k, c in base] + [(*m.span(), "format", ratio(m[0])) for m in runs if ratio(m[0]) >= secret_scan.MARGIN]
        assert sorted(map(tuple, out[i])) == sorted(want)
    assert all({s["kind"] for s in out[i]} == {"hex", "format"} for i in range(200, 260)) and out[260] == []
    assert np.mean([s["margin"] > secret_scan.MARGIN for i in range(200) for s in out[i] if s["kind"] == "assign"]) > 0.95


def test_states_merge():
    machine = secret_scan.Automaton(["ab" * k for k in range(1, 60)] * 20)
    assert len(machine.states) < 40 and machine.score("abab") > machine.score("ab9b")


def test_margins_stand_beside_their_spans_and_very_long_credentials_do_not_teach(spark):
    texts = [f"token = {'abcdef' * 3}{i:04d}" for i in range(60)] + ["token=" + "ab1" * 5_000]
    found = secret_scan.digest(secret_scan.scan(docs_of(spark, texts))).collect()
    assert all(len(r["margins"]) == len(r["spans"].split(",")) and r["margins"][0] is not None for r in found) and len(found) == 61
    learnt = spark.createDataFrame([("token=" + "ab1" * 5_000,)], "text string")
    assert secret_scan.learn(learnt) [0] == {}


def test_secrets_of_awkward_texts(spark, awkward, none):
    assert secret_scan.scan(clashing(awkward).drop("spans")).count() == awkward.count()
    assert secret_scan.scan(none).count() == 0


# 8 near duplicates


def linked(docs, size, percent):
    """id -> (set size, component) by all pairs that share a shingle."""
    sets, lists = {}, defaultdict(list)
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        for s in sets[i]:
            lists[s].append(i)
    common = Counter((a, b) for own in lists.values() for a in own for b in own if a < b)
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            low[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def grouped(df, size=4):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(df, size=size).collect()}


def test_near_groups_equal_brute_force(spark, documents):
    assert grouped(spark.read.parquet(f"{SF}/documents.parquet")) == linked(((i, r["text"]) for i, r in documents.items()), 4, 80)


def test_near_groups_of_a_large_family(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(250):
        words = list(base)
        for _ in range(rng.integers(1, 12)):
            words[rng.integers(0, 120)] = f"x{rng.integers(0, 400)}"
        texts.append(" ".join(words))
    texts.insert(100, " ".join(base))
    assert grouped(docs_of(spark, texts)) == linked(enumerate(texts), 4, 80)


def test_pairs_do_not_grow_with_the_square_of_a_family(spark, monkeypatch):
    """Five times the members make about five times the candidates, and the groups equal brute force."""
    seen, plain = [], near_dedup.written

    def counted(df, name):
        out = plain(df, name)
        if name in ("best", "pairs", "led"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    totals = []
    for n in (200, 1000):
        rng = np.random.default_rng(n)
        texts = []
        for _ in range(n):
            words = [f"w{i}" for i in range(150)]
            for at in rng.integers(0, 150, rng.integers(1, 14)):
                words[at] = f"x{rng.integers(0, 10_000)}"
            texts.append(" ".join(words))
        seen.clear()
        assert grouped(docs_of(spark, texts)) == linked(enumerate(texts), 4, 80)
        totals.append(sum(seen))
    assert totals[1] < 8 * totals[0] and totals[1] < 1000 * 20


def test_deviations_of_unlike_members_make_no_lists(spark):
    """Members that lack the same half of their leader and share nothing else, each in a task of its own."""
    leader, common = [f"l{i}" for i in range(50)], [f"c{i}" for i in range(50)]
    number = {w: np.uint64(k * 2_654_435_761 + 1) for k, w in enumerate([*leader, *common, *(f"m{m}x{i}" for m in range(12) for i in range(50))])}
    packed = lambda words: np.sort(np.array([number[w] for w in words], np.uint64)).tobytes()
    sets = [(0, packed([*leader, *common])), *((m + 1, packed([*common, *(f"m{m}x{i}" for i in range(50))])) for m in range(12))]
    pairs = spark.createDataFrame([(0, m + 1) for m in range(12)], "a bigint, b bigint")
    apart = near_dedup.deviations(pairs, spark.createDataFrame(sets, "id bigint, shingles binary"), 80)
    apart = near_dedup.written(apart.repartition(12, "b"), "apart")
    assert apart.where(F.col("class") > near_dedup.LINKED).count() == 12
    assert near_dedup.deviation_lists(apart, 80).count() == 0


def test_lists_of_deviations_are_open_however_full_the_counters_are(spark, monkeypatch):
    """Every counter is met many times, so none tells that a deviation is alone; no posting without a partner becomes a
    row, nor does one whose partners are all of its own component."""
    monkeypatch.setattr(near_dedup, "APART", near_dedup.SLICE)
    rng = np.random.default_rng(5)
    leader, shared_ = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, (20, 400)).astype(np.uint64)
    sets = [(0, np.sort(leader).tobytes())]
    for m in range(60):
        own = rng.integers(0, 1 << 63, 800).astype(np.uint64)
        sets.append((m + 1, np.sort(np.concatenate([leader[m : m + 400], own[:400] if m >= 40 else np.concatenate([shared_[m // 2], own[:30]])])).tobytes()))
    pairs = spark.createDataFrame([(0, m + 1) for m in range(60)], "a bigint, b bigint")
    apart = near_dedup.written(near_dedup.deviations(pairs, spark.createDataFrame(sets, "id bigint, shingles binary"), 80), "apart")
    assert apart.where(F.col("class") > near_dedup.LINKED).count() == 60
    labels = spark.createDataFrame([(m + 1, m + 1 - m % 2) for m in range(20)], "node bigint, component bigint")
    for given, first in ((None, 1), (labels, 21)):
        found = near_dedup.deviation_lists(apart, 80, given).toPandas()
        by_key = found.groupby("key")
        assert len(found) and (by_key["component"].nunique() > 1).all() and (by_key["id"].nunique() == by_key["n"].first()).all()
        together = {tuple(sorted(ids)) for _, ids in by_key["id"]}
        assert {(m, m + 1) for m in range(first, 41, 2)} <= together
        assert not {(m, m + 1) for m in range(1, first, 2)} & together
    one = spark.createDataFrame([(m + 1, 1) for m in range(60)], "node bigint, component bigint")
    assert near_dedup.deviation_lists(apart, 80, one).count() == 0


def test_members_of_one_side_make_no_lists(spark):
    """Two members share fewer deviations than a link asks for; posted for partners that are more like their leader, of
    which there are three that share none, they met each other."""
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    leader, both = draw(100), draw(10)
    sets = [leader, *(np.concatenate([leader[:k], leader[k + 20 :], draw(20)]) for k in (30, 50, 70)), *(np.concatenate([leader[30:], both, draw(20)]) for _ in range(2))]
    sets = spark.createDataFrame([(i, np.sort(x).tobytes()) for i, x in enumerate(sets)], "id bigint, shingles binary")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 6)], "a bigint, b bigint")
    apart = near_dedup.written(near_dedup.deviations(pairs, sets, 80), "apart")
    assert sorted(r["class"] for r in apart.collect()) == [6, 6, 6, 8, 8]
    assert near_dedup.deviation_lists(apart, 80).count() == 0


def test_linked_members_meet_on_both_sides_of_a_list(spark):
    """Members from like their leader to unlike it, in steps: each linked pair of which one is not linked to the leader,
    by brute force, is in a list, and its weights are no less than `least` tells."""
    rng = np.random.default_rng(12)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    leader, own = draw(100), draw(100)
    sets = [leader]
    for k in range(0, 100, 4):
        for _ in range(2):
            kept = np.concatenate([leader[k:], own[:k]])
            sets.append(np.concatenate([rng.choice(kept, 98, replace=False), draw(int(rng.integers(0, 9)))]))
    frame = spark.createDataFrame([(i, np.sort(x).tobytes()) for i, x in enumerate(sets)], "id bigint, shingles binary")
    pairs = spark.createDataFrame([(0, i) for i in range(1, len(sets))], "a bigint, b bigint")
    apart = near_dedup.written(near_dedup.deviations(pairs, frame, 80), "apart")
    by = {r["b"]: r for r in apart.collect()}
    found = near_dedup.deviation_lists(apart, 80).toPandas()
    met = {p for _, g in found.groupby("key") for x, s in zip(g["id"], g["side"]) for y, t in zip(g["id"], g["side"]) if x < y and (s != t or s == near_dedup.BOTH) for p in [(x, y)]}
    wanted = set()
    for x in by:
        for y in range(x + 1, len(sets)):
            if near_dedup.alike(len(sets[x]), len(sets[y]), len(np.intersect1d(sets[x], sets[y])), 80):
                assert by[x]["weight"] >= by[y]["least"] and by[y]["weight"] >= by[x]["least"]
                if max(by[x]["class"], by[y]["class"]) > near_dedup.LINKED:
                    wanted.add((x, y))
    assert len(wanted) > 50 and len({by[x]["class"] for p in wanted for x in p}) > 4 and wanted <= met


def test_near_groups_of_awkward_texts(spark, awkward, none):
    out = near_dedup.near_groups(clashing(awkward), size=4).collect()
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] != 3}
    assert len(out) == awkward.count()
    assert by_id[4]["component_id"] == by_id[5]["component_id"] == 3 and not by_id[4]["kept"] and by_id[9]["component_id"] == 8
    assert [by_id[i]["component_id"] for i in (0, 1, 2, 6, 7)] == [0, 1, 2, 6, 7] and by_id[None]["kept"]
    assert near_dedup.near_groups(none).count() == 0 and near_dedup.near_dedup(clashing(awkward)).columns == clashing(awkward).columns


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "a bigint, b bigint")
    out = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_labels_lie_in_few_files(spark):
    """A small graph costs no file, and so no task in the next job, for each partition of a shuffle."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.createDataFrame([(i, i + 1) for i in range(0, 200, 2)], "a bigint, b bigint")
        labels = graph.components(links)
        joined = graph.relabelled(labels, spark.createDataFrame([(1, 2), (999, 0)], "a bigint, b bigint"))
        for found in (labels, joined):
            assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        out = {r["node"]: r["component"] for r in joined.collect()}
        assert out == {i: 0 if i < 4 else i // 2 * 2 for i in range(200)} | {999: 0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# 9 languages


def test_languages_of_held_out_documents(spark, documents):
    got = queries.op9_language(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both["held_out"]]
    assert all(both["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both["doc_id"]])
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and both["score"].between(0, 1).all()


def test_gradients():
    network = language.Network(["a", "b", "c"], hidden=3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    rng = np.random.default_rng(8)
    words, lengths, target = rng.integers(97, 103, (5, 6)), np.array([6, 3, 1, 5, 2]), np.array([0, 1, 2, 0, 1])
    _, grads = network.gradients(words, lengths, target)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        side = []
        for e in (1e-2, -1e-2):
            network.p[k][at] += e
            side.append(network.gradients(words, lengths, target)[0])
            network.p[k][at] -= e
        assert abs((side[0] - side[1]) / 2e-2 - g[at]) < 1e-3 * max(1, abs(g[at])) + 1e-4


def test_padding_does_not_matter():
    network = language.Network(["a", "b"])
    word = np.frombuffer(b"hello", np.uint8)[None]
    padded = np.pad(word, ((0, 0), (0, 9)))
    assert np.allclose(network.probabilities(word, np.array([5])), network.probabilities(padded, np.array([5]))[:5], atol=1e-6)


def test_pooling_equals_a_plain_reading(monkeypatch):
    """Byte by byte, from CONTEXT bytes before a piece and back from CONTEXT bytes behind it."""
    monkeypatch.setattr(language, "PIECE", 20)
    monkeypatch.setattr(language, "CONTEXT", 6)
    network = language.Network(["a", "b", "c"])
    p, h = {k: v.astype(np.float64) for k, v in network.p.items()}, network.hidden

    def read(raw, way):
        state, out = np.zeros(h), []
        for c in raw:
            x, u = p["x" + way][c], state @ p["u" + way]
            reset, stay = (1 / (1 + np.exp(-(x[k * h : k * h + h] + u[k * h : k * h + h]))) for k in (0, 1))
            new = np.tanh(x[2 * h :] + reset * u[2 * h :])
            state = new + stay * (state - new)
            out.append(state)
        return out

    texts = ["Hello, world! It is 12 o'clock, and ÄÖ too.", "", "1 2", "x" * 20, "日本語の文章がここにあります"]
    want = []
    for text in texts:
        raw, mass, n = text.lower().replace("ä", "Ä").replace("ö", "Ö").encode(), np.zeros(3), 0
        for at in range(0, len(raw), 20):
            low, high = max(0, at - 6), min(len(raw), at + 26)
            ahead, back = read(raw[low:high], "f"), read(raw[low:high][::-1], "b")[::-1]
            for k in range(at, min(at + 20, len(raw))):
                if chr(raw[k]).isalpha() and raw[k] < 128 or raw[k] >= 128:
                    z = np.exp(ahead[k - low] @ p["vf"] + back[k - low] @ p["vb"] + p["c"])
                    mass, n = mass + z / z.sum(), n + 1
        want.append(mass / max(1, n))
    got = network.pooled(*kernels.string_bytes(pa.array(texts)))
    assert np.allclose(got, want, atol=1e-5)


def test_unspaced_text_teaches_from_all_over(spark):
    rng = np.random.default_rng(2)
    text = lambda low: "".join(chr(low + int(c)) for c in rng.integers(0, 40, 3_000))
    docs = spark.createDataFrame([(i, text(0x4E00 if i % 2 else 0x3040), "zh" if i % 2 else "ja") for i in range(40)], "doc_id bigint, text string, lang string")
    pieces = language.training_pieces(docs, "doc_id", "text", "lang").toPandas()
    assert pieces["piece"].map(len).sum() == sum(len(r["text"].encode()) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2)
    got = language.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas())
    assert (got["lang_pred"] == got["lang"]).all()


def test_very_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ALL", 60)
    df = spark.createDataFrame([(i, f"text number {i} " * 40, f"l{i % 90}", "s", 1) for i in range(400)], DOCS)
    pieces = language.training_pieces(df, "doc_id", "text", "lang")
    assert 5 < pieces.count() < 200 and pieces.select("lang").distinct().count() > 5
    monkeypatch.setattr(language, "STEPS", 2)
    assert language.identify(df.limit(50)).count() == 50


def test_languages_of_awkward_texts(spark, awkward, none):
    got = {r["doc_id"]: r for r in language.identify(clashing(awkward)).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and got[10]["lang_pred"] != "und" and got[0]["score"] == 0
    assert language.identify(none).count() == 0
    unknown = docs_of(spark, ["text", "12 ..."]).withColumn("lang", F.lit(None).cast("string"))
    assert [r["lang_pred"] for r in language.identify(unknown).collect()] == ["und", "und"]


# 10 exact duplicates


def test_colliding_digests_are_told_apart(spark):
    texts = ["aa", "bb", "aa", "cc  d", "cc d", "bb", ""]
    got = exact_dedup.exact_groups(docs_of(spark, texts), digest=lambda text: F.length(text).cast("string")).orderBy("doc_id").collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in got] == [(0, 2, True), (1, 2, True), (0, 2, False), (3, 2, True), (3, 2, False), (1, 2, False), (6, 1, True)]


def test_hot_groups_are_compared_in_copies(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_PER_COPY", 7)
    got = exact_dedup.exact_groups(docs_of(spark, ["same text"] * 50 + ["other"])).collect()
    assert Counter(r["group_size"] for r in got) == {50: 50, 1: 1} and sum(r["kept"] for r in got) == 2


def test_exact_groups_of_awkward_texts(spark, awkward, none):
    got = exact_dedup.exact_groups(clashing(awkward)).collect()
    assert len(got) == awkward.count()
    long = [r for r in got if r["keep_id"] == 3 and r["group_size"] == 5]
    assert len(long) == 5 and sum(r["kept"] for r in long) == 1 and any(r["doc_id"] is None for r in long)
    assert [r["group_size"] for r in got if r["doc_id"] in (0, 1)] == [2, 2]
    assert exact_dedup.exact_groups(none).count() == 0


def test_stages_keep_one_row_of_each_group(spark):
    near = LONG.replace("wizards", "witches")
    given = [(1, LONG), (1, LONG), (2, LONG), (1, "other text of the same id"), (5, "other text of the same id"), (0, "other text of the same id")]
    given += [(None, LONG), (None, "no id"), (None, "no id"), (None, "alone without id"), (None, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(given)], "doc_id bigint, text string, lang string")
    exact = exact_dedup.exact_dedup(docs).collect()
    want = [(0, "other text of the same id"), (1, LONG), (9, None), (None, "alone without id"), (None, "no id")]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in exact) == sorted((i is None, i or 0, t or "") for i, t in want)
    more = docs.unionByName(spark.createDataFrame([(None, near, "x"), (7, near, "y")], docs.schema))
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.near_dedup(more, percent=40).collect()]
    assert sum(t in (LONG, near) for _, t in kept) == 1 and (1, LONG) in kept
    assert [i for i, t in kept if t == "other text of the same id"] == [0]
    assert sorted(t or "" for _, t in kept) == sorted([LONG, "other text of the same id", "no id", "alone without id", "", ""])


def test_stages_survive_clashing_names(spark, awkward):
    docs = clashing(awkward)
    bench = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    for out in (exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs), decontaminate.decontaminate(docs, bench)):
        assert out.columns == docs.columns and 0 < out.count() < docs.count()


def test_rows_without_id_are_not_paired_with_each_other(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the same text").alias("text"))
    out = exact_dedup.exact_groups(docs).groupBy("group_size", "kept").count().collect()
    assert sorted((r["group_size"], r["kept"], r["count"]) for r in out) == [(20_000, False, 19_999), (20_000, True, 1)]


def test_a_later_run_continues_the_state(spark, tmp_path):
    path = str(tmp_path / "state")
    for k, texts in enumerate((["a", "b"], ["b", "c"])):
        rows_ = docs_of(spark, texts, start=10 * k).select(exact_dedup.sha256_digest(F.col("text")).alias("digest"), F.struct(F.lit(False).alias("no_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("row")).alias("at"))
        rows_.write.mode("append").parquet(f"{path}/arrivals")
        state = exact_dedup.run_stream(spark.read.parquet(f"{path}/arrivals"), path)
    assert sorted((r["keep"]["id"], r["n"]) for r in state.collect()) == [(0, 1), (1, 2), (11, 1)]


def test_later_batches_find_retained_state(spark, tmp_path):
    texts = ["same", "a", "same", "b", "b", "same"] * 20
    out = exact_dedup.exact_groups(docs_of(spark, texts).repartition(9), state_dir=str(tmp_path / "s"))
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out.collect()} == {(i, texts.index(t), texts.count(t)) for i, t in enumerate(texts)}
    assert len([f for f in os.listdir(tmp_path / "s" / "checkpoint" / "commits") if f.isdigit()]) >= 3
    changed = spark.read.parquet(str(tmp_path / "s" / "state"))
    assert changed.where("batch > 0").count() > 0 and changed.groupBy("digest").count().where("count > 1").count() > 0


# pipeline


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[-1]) > 100
    good = {r["doc_id"] for r in queries.op3_quality(spark, SF).where("kept").collect()}
    assert ids[1] == good
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {}
    for i in sorted(ids[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert ids[2] == set(first.values())
    groups = linked(((i, texts[i]) for i in ids[2]), 5, 80)
    assert ids[3] == {i for i, (_, c) in groups.items() if c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[4] == ids[3] - {d for d, _ in contaminated([(i, texts[i]) for i in ids[3]], items)}
    mixed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(mixed["doc_id"]) <= ids[4] and list(mixed.columns) == ["doc_id", "domain", "lang", "source", "tokens", "epoch", "budget"]


@pytest.fixture(scope="module")
def odd_corpus(spark, awkward, tmp_path_factory):
    """A folder with documents that have nulls, repeated rows, tied ids and columns named like those of stages."""
    folder = tmp_path_factory.mktemp("odd")
    prose = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = awkward.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, LONG, None, "src0", 3), (7, LONG, "en", "src1", 3)], DOCS)
    clashing(prose.unionByName(odd).unionByName(nulls).unionByName(prose.limit(5))).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(None, None), (5, " ")], "item_id bigint, text string")).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_the_pipeline_on_awkward_rows(spark, odd_corpus):
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, odd_corpus).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count() and kept.exceptAll(before).count() == 0
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in kept.select("text").collect()]
    assert len(texts) == len(set(texts))
    mixed = corpus_pipeline.run(spark, odd_corpus).collect()
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert mixed and {r["doc_id"] for r in mixed} <= ids and all(0 <= r["epoch"] < 3 and r["tokens"] > 0 for r in mixed)


def test_the_pipeline_on_empty_tables(spark, tmp_path, none):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# 11 n-gram join


def link_groups(texts, size, percent):
    """(set size, least reachable) of each text, by comparing all pairs of shingle sets."""
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    low = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    low[i] = low[j] = min(low[i], low[j])
    return [(len(x), low[i]) for i, x in enumerate(sets)]


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_joined_groups_equal_brute_force(spark, percent):
    rng = np.random.default_rng(percent)
    texts = []
    for _ in range(14):
        base = [f"w{k}" for k in rng.integers(0, 60, rng.integers(1, 90))]
        for _ in range(int(rng.integers(1, 7))):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 4)):
                words[at] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(words[: len(words) - int(rng.integers(0, 3))]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_groups(docs_of(spark, texts), 3, percent).collect()}
    assert [got[i] for i in range(len(texts))] == link_groups(texts, 3, percent)


def test_links_at_exactly_the_threshold_are_found(spark):
    """Sets of 9 and 9 elements that share 8 are at 8 / 10; those that share 7 are not linked."""
    words = [f"w{i}" for i in range(13)]
    texts = [" ".join(words), " ".join([*words[:12], "other"]), " ".join([*words[:11], "else", "where"])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_groups(docs_of(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2} == dict(enumerate(low for _, low in link_groups(texts, 5, 80)))


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(5)
    for n in (1, 3, 20, 200, 3_000):
        for share in (0.0, 0.5, 0.8, 0.9, 1.0):
            own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            other = np.unique(np.concatenate([own[: int(len(own) * share)], rng.integers(0, 1 << 63, int(n * 1.2 * (1 - share)) + 1).astype(np.uint64)]))
            common = len(np.intersect1d(own, other))
            differ = ngram_join.apart(*(ngram_join.bitmap(x, ngram_join.bits(len(x))).tobytes() for x in (own, other)))
            assert (len(own) + len(other) - differ) // 2 >= common
    assert (ngram_join.band(np.array([80, 100]), 80)[::-1] - ngram_join.band(np.array([80, 100]), 80)).max() <= 1


def test_counters_hold_every_shingle_however_texts_are_dealt(spark):
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(1, 60)) for i in range(40)]
    dealt = [ngram_join.occurrences(docs_of(spark, texts).repartition(n), 5, "text") for n in (1, 13)]
    assert dealt[0].sum() == sum(len(t.split()) - 4 for t in texts) and (dealt[0] == dealt[1]).all()


def test_a_large_family_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(400):
        words = list(base)
        for at in rng.integers(0, 200, 2):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    tested, tell = [], ngram_join.bounded
    monkeypatch.setattr(ngram_join, "bounded", lambda pairs, *a: (tested.append(pairs.count()), tell(pairs, *a))[1])
    out = ngram_join.join_groups(docs_of(spark, texts)).collect()
    assert {r["component_id"] for r in out} == {0} and sum(tested) < 4_000


@pytest.mark.parametrize("groups", [lambda d: ngram_join.join_groups(d), lambda d: near_dedup.near_groups(d, 5)])
def test_an_id_with_several_texts_keeps_all_links(spark, groups):
    a, b = LONG, " ".join(f"v{i}" for i in range(40))
    rows_ = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, "alone here"), (None, a)]
    df = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows_], DOCS)
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in groups(df).collect())
    assert got == [(-1, None), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_joined_groups_of_awkward_texts(spark, awkward, none):
    out = ngram_join.join_groups(clashing(awkward)).collect()
    assert len(out) == awkward.count()
    got = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    assert got[0] == 0 and got[1] == 1 and got[2] == 2 and got[4] == got[3] == got[5] == 3 and got[9] == got[8] == 8 and got[10] == 10
    assert ngram_join.join_groups(none).count() == 0


# 12 source divergence


def audited(texts, least=10):
    """The audit by plain counting."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows_ = [(terms(t), lang or "", source or "") for t, lang, source in texts]
    out = []
    for lang in {r[1] for r in rows_}:
        own = [r for r in rows_ if r[1] == lang]
        seen = Counter(w for t, _, _ in own for w in set(t))
        kept = [w for w in seen if seen[w] >= least]
        count = defaultdict(Counter)
        for t, _, source in own:
            count[source].update(w for w in t if w in kept)
        whole = sum(count.values(), Counter())
        share = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in count if o != s]
            found = [(-f(p[s][w], q[w]), w.encode()) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(found)[:10])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "sources", "rows_most"), [(4_096, 64, 1 << 20), (3, 2, 5)])
def test_divergence_equals_plain_counting(spark, monkeypatch, chunk, sources, rows_most):
    for name, value in (("CHUNK", chunk), ("SOURCES", sources), ("ROWS", rows_most)):
        monkeypatch.setattr(divergence, name, value)
    rng = np.random.default_rng(9)
    vocabulary = ["The", "the", "Éa", "éa", "ß", "日本", "x", "zz", "aB", "ab9c", "z-z", "🎉", "a" * 3_000]
    texts = [(" ".join(rng.choice(vocabulary, rng.integers(0, 9), p=None)), ["en", "de", None][int(rng.integers(3))], ["a", "b", "é", "", None][int(rng.integers(5))]) for _ in range(220)]
    texts += [("rare words only", "xx", "a"), (None, "xx", "b"), ("", "yy", "a"), ("x" * 200_000, "en", "a")]
    df = clashing(spark.createDataFrame([(i, *t, 0) for i, t in enumerate(texts)], DOCS))
    got = sorted(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audited(texts) and {r[2] for r in got} == {"pair", "term"} and ("xx", "a", "pair", "b", 0, 1) in got


def test_divergence_of_awkward_texts(spark, awkward, none):
    got = sorted(tuple(r) for r in divergence.audit(clashing(awkward)).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audited([(r["text"], r["lang"], r["source"]) for r in awkward.collect()]) and divergence.audit(none).count() == 0


def test_shares_are_exact():
    for count, total, kept in [(0, 0, 1), (5, 7, 3), (10**12, 10**12, 10**6), (10**15 - 1, 3 * 10**15, 10**7)]:
        assert divergence.shares(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)


# 13 conversation repair


def cheapest(turns):
    """(cost, audit) of turns (initial, must go, truncated): every path, as whole strings."""
    ways = {"": (0, "")}
    for initial, must_go, cut in turns:
        found = defaultdict(list)
        for state, (cost, audit) in ways.items():
            found[state].append((cost + 3, audit + "D"))
            if must_go:
                continue
            if not state and initial == "s":
                found["s"].append((cost + cut, audit + "K"))
            for role in "ua":
                insert = "I" if state == role or role == "a" and state in ("", "s") else ""
                found[role].append((cost + 2 * len(insert) + cut + 2 * (initial != role), audit + insert + ("K" if initial == role else "R")))
        ways = {k: min(v) for k, v in found.items()}
    last = {"": "", "a": "", "u": "I", "s": "II"}
    return min((cost + 2 * len(last[k]), audit + last[k]) for k, (cost, audit) in ways.items())


def every_edit(turns):
    """(cost, audit) by trying every sequence of edits; only for a few turns."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]

    def go(k, cost, audit, roles):
        nonlocal best
        for extra in inserts:
            c, a, r = cost + 2 * len(extra), audit + "I" * len(extra), roles + extra
            if k == len(turns):
                if re.fullmatch(r"(s?(ua)+)?", r) and (best is None or (c, a) < best):
                    best = (c, a)
                continue
            initial, must_go, cut = turns[k]
            go(k + 1, c + 3, a + "D", r)
            if not must_go:
                go(k + 1, c + cut, a + "K", r + initial)
                for role in "ua":
                    go(k + 1, c + 2 + cut, a + "R", r + role)

    go(0, 0, "", "")
    return best


def test_paths_equal_every_sequence_of_edits():
    rng = np.random.default_rng(2)
    for n in (1, 2, 2, 3, 3, 3):
        turns = [("suax"[int(rng.integers(4))], bool(rng.random() < 0.2), bool(rng.random() < 0.3)) for _ in range(n)]
        assert cheapest(turns) == every_edit(turns)


def plain_repair(rows_):
    """The contract of `repair`, turn by turn, for rows (turn, role, text) of one conversation."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    rows_ = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows_], key=key)
    seen, faults = set(), []
    for _, role, text in rows_:
        end = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
        seen.add((role, text))
    cost, audit = cheapest([(role[:1], f in (1, 2), f == 3) for (_, role, _), f in zip(rows_, faults, strict=True)])
    lines, k, system = [], 0, 0
    for op in audit:
        name = ["user", "assistant"][(len(lines) - system) % 2]
        if op == "I":
            lines.append(f"{name}:")
            continue
        role, text = rows_[k][1:]
        k += 1
        if op == "K":
            system |= not lines and role[:1] == "s"
            lines.append(f"{role}:{text}")
        elif op == "R":
            lines.append(f"{name}:{text}")
    turns = [t for t, _, _ in rows_ if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows_, rows_[1:], strict=False))
    return (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


REPAIRED = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize(("segment", "piece"), [(4_096, 1 << 20), (3, 20)])
def test_repair_equals_a_plain_reading(spark, monkeypatch, segment, piece):
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    monkeypatch.setattr(turn_repair, "PIECE", piece)
    rng = np.random.default_rng(segment)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "amber"], ["Yes.", "No", "  ", "", None, "Why?  ", "é!", "a\nb.", "Cut off", "x" * 400 + "."]
    turns = []
    for conv in [*range(40), None]:
        n = int(rng.integers(1, 12)) if conv != 7 else 200
        turns += [(conv, None if rng.random() < 0.1 else int(rng.integers(0, n)), roles[int(rng.choice(7, p=[0.1, 0.35, 0.35, 0.05, 0.05, 0.05, 0.05]))], texts[int(rng.integers(len(texts)))]) for _ in range(n)]
    df = clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: tuple(r[c] for c in REPAIRED) for r in turn_repair.repair(df).collect()}
    assert got == {c: plain_repair([t[1:] for t in turns if t[0] == c]) for c in {t[0] for t in turns}}


def test_damaged_conversations_equal_sql_and_a_plain_reading(spark):
    turns = [(c, t, ["user", "assistant"][t % 2], f"Turn {t} of {c}. Well?") for c in range(30) for t in range(5)]
    turns += [(50, t, "user", "Same.") for t in range(40)] + [(51, None, None, None), (None, 1, "user", "Lost?"), (52, 3, "system", "S.")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = turn_repair.repair_damaged(clashing(df))
    want = on_table(df, "conversations", queries.oracle_sql()["op13_repair_turns"])
    assert rows(got.toPandas().convert_dtypes()) == rows(want.convert_dtypes())  # a null conv_id makes floats of the others
    damaged = defaultdict(list)
    for conv, turn, role, text in turns:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text or " ") if kind == 2 else text or " "
        damaged[conv] += [(turn, "user" if kind == 4 else role or " ", text)] * [0, 1, 1, 2, 1][kind] if kind < 5 else [(turn, role or " ", text)]
    assert {r["conv_id"]: tuple(r[c] for c in REPAIRED) for r in got.collect()} == {c: plain_repair(v) for c, v in damaged.items()}
    assert turn_repair.repair_damaged(df.limit(0)).count() == 0
