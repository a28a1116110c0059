"""Classifier and language model: held-out accuracy, exact parts against brute force, edge rows."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import lm, quality
from lexiframe.llm.common import crc_mod
from lexiframe.llm.queries import op2_quality_classifier, op3_lm_scoring

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def test_classifier_is_right_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = op2_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held) and sum(r["held_out"] for r in rows) == len(held)
    right = [r["predicted"] == r["quality"] for r in held]
    bad = [r["predicted"] == 0 for r in held if r["quality"] == 0]
    assert sum(right) / len(right) > 0.97 and sum(bad) / len(bad) > 0.8
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def small_model(spark, labels):
    good = [(i, f"the good text {i} goes on and on") for i in range(60)]
    bad = [(100 + i, f"BUY!! {i} NOW!! NOW!!") for i in range(60)]
    docs = spark.createDataFrame(good + bad, DOCS)
    return docs, quality.fit(docs, spark.createDataFrame(labels, LABELS), bits=12)


def test_texts_of_all_kinds_get_a_score(spark):
    labels = [(i, int(i < 100), 0) for i in [*range(60), *range(100, 160)]] * 2
    labels += [(5, 0, 0), (None, 1, 0), (7, None, 0), (9999, 1, 0)]
    _, model = small_model(spark, labels)
    texts = [None, "", " \n", "the good text", "BUY!! NOW!!", "x " * 100_000, " ", "BUY!! NOW!!"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "1 as __id", "0 as quality")
    rows = sorted(quality.with_scores(docs, model).select("doc_id", "score").collect())
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0]["score"] == rows[1]["score"] == rows[2]["score"]
    assert rows[3]["score"] > 0.9 > 0.1 > rows[4]["score"] == rows[7]["score"]
    assert quality.with_scores(docs.limit(0), model).collect() == []


def test_few_labels(spark):
    assert small_model(spark, [])[1] == {"constant": 0.5}
    assert small_model(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0)])[1] == {"constant": 1.0}
    assert small_model(spark, [(1, 1, 0), (1, 0, 0)])[1] == {"constant": 0.5}


def test_held_out_labels_are_never_learnt(spark):
    held = [i for i in [*range(60), *range(100, 160)] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and small_model(spark, [(i, int(i < 100), 0) for i in held])[1] == {"constant": 0.5}


def test_dual_descent_finds_the_hinge_optimum():
    """The primal and dual objectives meet."""
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, rng.integers(3, 12), replace=False)) for _ in range(60)]
    labels = np.array([int(r[0] < 4) for r in rows])
    ratios = quality.log_count_ratios(rows, labels, 40)
    weights, bias = quality.dual_descent(rows, labels, ratios, 40, epochs=400)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    cost = 0.5 / share[labels]

    def primal(w, b):
        x = [ratios[r] / np.sqrt((ratios[r] ** 2).sum()) for r in rows]
        loss = np.array([max(0.0, 1 - s * (w[r] @ v + b)) for s, r, v in zip(sign, rows, x, strict=True)])
        return 0.5 * (w @ w + b * b) + (cost * loss).sum()

    best = primal(weights, bias)
    for _ in range(200):
        assert primal(weights + rng.normal(0, 0.05, 40), bias + rng.normal(0, 0.05)) >= best - 1e-3


def test_shapes_and_repeats():
    assert quality.word_shape(b"EDTH!!") == "A!" and quality.word_shape("Épa9".encode()) == "Aa0"
    features = quality.Features()
    one, two = features.of(b"xx yy zz"), features.of(b"xx xx xx")
    assert len(np.intersect1d(features.of(b"qq qq qq"), two)) >= 3 > len(np.intersect1d(one, two)) - 2
    features.most = 0  # forgets its words before every text and gives the same
    assert (features.of(b"xx yy zz") == one).all()


def plain_base(rows, train):
    tokens = lambda text: [
        *re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")),
        None,
    ]
    counts = Counter(t for doc, text in rows if train(doc) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    return sorted(
        (
            str(doc),
            len(tokens(text)),
            sum(counts[t] > 0 for t in tokens(text)),
            total,
            round(sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens(text)), 6),
        )
        for doc, text in rows
    )


def trained(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 != 0


def scored(spark, rows, **parameters):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as word", "1 as n", "2 as uid")
    return lm.lm_scores(df, crc_mod(F.col("doc_id"), 10) != 0, **parameters).collect()


ODD = [
    (0, None), (1, ""), (2, "  A a\u0085"), (3, "É é"), (4, "one two"), (4, "one two"), (None, "lost"),
    (5, "w " * 30_000), (6, " ".join(f"v{i}" for i in range(5000))),
]


@pytest.mark.parametrize("known_words", [1 << 19, 12, 0])
def test_base_scores_are_exact(spark, known_words):
    rows = [*ODD, *((i, f"the word{i % 7} and The rest{i}") for i in range(10, 80))]
    got = scored(spark, rows, known_words=known_words)
    have = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert have == plain_base(rows, trained)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 4]
    assert same[0] == same[1]


def test_no_documents_and_none_to_learn_from(spark):
    assert scored(spark, ODD[:0]) == []
    held = [(i, "some words") for i in range(200) if not trained(i)]
    got = scored(spark, held)
    assert len(got) == len(held) and all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)


def test_model_prefers_text_like_the_corpus(spark):
    folder = "/root/testdata/sf0.01"
    rows = op3_lm_scoring(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    mean = {r[0]: r[1] for r in rows.where("held_out").groupBy("quality").agg(F.avg(F.col("score") / F.col("n_tokens"))).collect()}
    assert mean[1] > mean[0]


def toy_tables(classes=lm.CLASSES):
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 300)
    base = lm.symbol_table(counts, np.arange(300) % 2 == 0, 9, symbols=lm.SYMBOLS)
    tables = lm.subword_tables(base, np.arange(lm.SYMBOLS) % 3)
    units = len(tables["prior"])
    pairs = np.log10(np.tile(np.maximum(tables["prior"], 1e-12), (lm.SYMBOLS + 3, 1))).astype(np.float32)
    assert pairs.shape[1] == units
    return tables | {"pairs": pairs}


def test_next_subword_probabilities_sum_to_one():
    tables = toy_tables()
    scorer = lm.Scorer(lm.new_parameters(1), tables)
    for context in ([], [5], list(range(40, 75))):
        total = 0.0
        symbols, ahead = scorer.blocks(np.array(context, np.int64))
        at = len(context)
        for i in range(301):
            only = np.full_like(ahead, -1)
            only[at // lm.BLOCK, at % lm.BLOCK] = i
            total += 10 ** scorer.block_scores(symbols, only).sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_blocks_equal_one_token_at_a_time():
    """Batched masked attention gives what a plain loop over positions and their windows gives."""
    tables, p = toy_tables(), lm.new_parameters(4)
    scorer = lm.Scorer(p, tables)
    ids = np.random.default_rng(1).integers(0, 300, 77)
    inputs = [lm.START, *tables["symbol"][ids]]
    want = 0.0
    for t, target in enumerate([*ids, 300]):
        first = max(0, (t // lm.BLOCK - 1) * lm.BLOCK)
        e = p["embed"][inputs[first : t + 1]]
        scores = e @ p["key"] @ (e[-1] @ p["query"]) / np.sqrt(lm.WIDTH) + p["near"][np.arange(t - first, -1, -1)]
        a = np.exp(scores - scores.max())
        c = (a / a.sum()) @ (e @ p["value"])
        z = np.tanh(e[-1] @ p["own"] + c @ p["mix"] + p["shift"]) @ p["out"] + p["bias"]
        z = z - z.max()
        want += (z[tables["kind"][target]] - np.log(np.exp(z).sum())) / np.log(10)
        want += tables["share"][target] + tables["pairs"][inputs[t], tables["unit"][target]]
    assert scorer.scores([ids])[0] == pytest.approx(want, abs=1e-3)
    many = scorer.scores([ids, ids[:0], ids[:16], ids])
    assert many[0] == many[3] and many[0] == pytest.approx(want, abs=1e-3)


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    p = {n: v.astype(np.float64) for n, v in lm.new_parameters(2).items()}
    symbols = rng.integers(0, 20, (6, 2 * lm.BLOCK))
    symbols[0, : lm.BLOCK] = lm.PAD
    kinds = rng.integers(-1, lm.CLASSES, (6, lm.BLOCK))
    _, g = lm.gradients(p, symbols, kinds)
    for name in p:
        flat = p[name].reshape(-1)
        for at in rng.choice(min(len(flat), 20 * lm.WIDTH), 3):
            old = flat[at]
            flat[at] = old + 1e-5
            up = lm.gradients(p, symbols, kinds)[0]
            flat[at] = old - 1e-5
            down = lm.gradients(p, symbols, kinds)[0]
            flat[at] = old
            assert np.asarray(g[name]).reshape(-1)[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_every_block_of_every_document_is_trained(spark):
    """The pieces give the windows that scoring gives, starts and ends included, at any length."""
    ranks = spark.sparkContext.broadcast(lm.read_ranks(lm.TOKENIZER))
    symbol = (np.arange(len(ranks.value) + 1) % lm.SYMBOLS).astype(np.int16)
    scorer = lm.Scorer(lm.new_parameters(1), toy_tables() | {"symbol": symbol, "kind": np.zeros(len(symbol), np.int16)})
    lexicon = lm.Lexicon(lm.subword_encoder(ranks.value))
    texts = [None, "", *(" ".join(f"w{i * j}" for i in range(n)) for j, n in enumerate([1, 7, 16, 17, 300, 3000]))]
    want = Counter()
    for text in texts:
        ids = lexicon.subwords(lexicon.of(lm.words_of(text.encode() if text else None)))
        want.update((s.tobytes(), a.tobytes()) for s, a in zip(*scorer.blocks(ids), strict=True))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    pieces = lm.training_pieces(docs, len(symbol) - 1, ranks, most=4).toArrow()
    have = Counter()
    for symbols, ahead in lm.window_chunks(pieces.to_batches(), symbol, 10):
        have.update((s.tobytes(), a.tobytes()) for s, a in zip(symbols, ahead, strict=True))
    assert have == want and sum(want.values()) > 300


def test_copies_of_a_text_are_dealt_to_many_tasks(spark):
    pieces = spark.range(4000).selectExpr("true as first", "cast('same text' as binary) as ids")
    dealt = lm.dealt_pieces(pieces, 8)
    assert dealt.columns == ["first", "ids"] and dealt.count() == 4000
    sizes = [r["count"] for r in dealt.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700


def test_training_holds_a_bounded_number_of_windows(monkeypatch):
    """One group of equal windows passes through a task in batches."""
    seen = []
    monkeypatch.setattr(lm, "gradients", lambda p, s, k: (seen.append(len(s)), (0.0, p))[1])
    chunks = ((np.zeros((300, 2 * lm.BLOCK), np.int16), np.zeros((300, lm.BLOCK), np.int64)) for _ in range(20))
    assert lm.train_locally(lm.new_parameters(1), chunks, 20)[1] == sum(seen) == 6000 and max(seen) == lm.BATCH


def test_cells_reach_the_driver_as_columns(spark, monkeypatch):
    """Half a million cells as Python rows took the driver more than 100 MB."""
    cells = spark.range(1 << 19).selectExpr("id as cell", "id * 3 as n")
    monkeypatch.setattr(type(cells), "collect", None)
    into = np.zeros((1 << 19) + 5)
    tracemalloc.start()
    lm.fill(into, cells.where("cell <> 7"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.append(np.arange(1 << 19) * 3.0, np.zeros(5))
    want[7] = 0
    assert (into == want).all() and peak < 60 << 20
    lm.fill(into, cells.limit(0))
    assert (into == want).all()


def test_words_are_cut_alike_one_by_one_and_together():
    encoder = lm.subword_encoder(lm.read_ranks(lm.TOKENIZER))
    words = [b"the", "été".encode(), b"a1!b", b"\xff", b"x" * 300, *(f"w{i * i}".encode() for i in range(3000))]
    for some in (words, [*words, "a ".encode(), "\u0085b".encode(), b"end"], []):
        ids, sizes = encoder.many(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [encoder(word) for word in some]


def test_pieces_hold_all_that_scoring_needs(spark):
    """Texts are cut once for training and scoring."""
    ranks = spark.sparkContext.broadcast(lm.read_ranks(lm.TOKENIZER))
    known = spark.sparkContext.broadcast({"words": [b"the"], "logs": np.array([2.0]), "end": 0.5, "ends": 3})
    texts = [None, " ", "The the rest", " ".join(f"w{i % 300}" for i in range(900))]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("doc_id", "text", "doc_id = 2 as trained")
    got = lm.training_pieces(docs, len(ranks.value), ranks, most=4, known=known).collect()
    assert {r["doc_id"]: r["trained"] for r in got} == {0: False, 1: False, 2: True, 3: False}
    facts = {r["doc_id"]: r for r in got if r["first"]}
    assert len(facts) == 4 and all(r["n_tokens"] is None and r["rare"] is None for r in got if not r["first"])
    assert [facts[i]["n_tokens"] for i in range(4)] == [1, 1, 4, 901] and [facts[i]["n_known"] for i in range(4)] == [1, 1, 3, 1]
    assert [facts[i]["logs"] for i in range(4)] == [0.5, 0.5, 4.5, 0.5] and facts[2]["rare"] == [b"rest"]
    assert dict(zip(facts[3]["rare"], facts[3]["times"], strict=True)) == {f"w{i}".encode(): 3 for i in range(300)}
    assert all(sum(r["n_subwords"] for r in got if r["doc_id"] == i and r["first"]) > 0 for i in (2, 3))
