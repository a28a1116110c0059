"""Decontamination against brute force, and the pipeline stage by stage."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiframe.llm import decontaminate as dc
from lexiframe.llm.words import words_of

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_force(docs, items):
    """Leaks by comparing every window of every document with every item."""
    out = set()
    for item_id, text in items:
        own = words_of((text or "").encode())
        if len(own) < dc.MIN_WORDS:
            continue
        assert len(own) <= dc.PIECE
        answer = dc.answer_words((text or "").lower().encode())
        for doc_id, body in docs:
            words = words_of((body or "").encode())
            last = max(1, -(-len(words) // dc.STEP) - dc.WINDOW // dc.STEP + 1)
            for at in range(last if words else 0):
                window = words[at * dc.STEP : at * dc.STEP + dc.WINDOW]
                common = plain_lcs(own, window)
                answered = dc.has_run(window, answer)
                if common >= dc.LCS * len(own) or common >= dc.PARAPHRASE * len(own) and answered:
                    out.add((doc_id, item_id))
    return out


def found(spark, docs, items):
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as row", "'y' as words", "2 as item_id")
    rows = dc.find_leaks(df, spark.createDataFrame(items, ITEMS)).collect()
    assert len({(r["doc_id"], r["item_id"], r["start"]) for r in rows}) <= len(rows)
    return rows


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(3000)]
    draw = lambda n: [rng.choice(vocabulary[: rng.choice([20, 300, 3000])]) for _ in range(n)]
    items = []
    for i in range(25):
        w = draw(rng.randint(10, 60))
        w[len(w) // 2] += "."
        items.append((i, " ".join(w)))
    docs = []
    for i in range(120):
        w = draw(rng.choice([5, 40, 150, 600]))
        if i % 3 == 0:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                leak[rng.randrange(len(leak))] = "changed"
            if rng.random() < 0.3:
                leak = leak[: len(leak) // 2] + draw(3) + leak[len(leak) // 2 :]
            at = rng.randrange(len(w))
            w[at:at] = leak
        docs.append((i, " ".join(w)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_search_finds_what_brute_force_finds(spark, seed):
    docs, items = corpus(seed)
    want = brute_force(docs, items)
    have = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items)}
    assert have <= want and len(want) >= 30
    assert len(have) >= 0.97 * len(want)


def test_paraphrases_without_their_rare_words_are_found(spark):
    """The 40% of an item's words that weigh most are replaced, its answer is kept."""
    rng = random.Random(5)
    common, docs, items = [f"c{i}" for i in range(60)], [], []
    for i in range(40):
        rare = [f"r{i}x{j}" for j in range(12)]
        body = rng.sample(common, 15) + rare
        rng.shuffle(body)
        answer = rng.sample(common, 4)
        items.append((i, " ".join(body) + ". " + " ".join(answer)))
        changed = [f"n{rng.randrange(9000)}" if w in rare else w for w in body]
        changed[-1] += "."
        filler = [rng.choice(common) if rng.random() < 0.4 else f"f{rng.randrange(5000)}" for _ in range(200)]
        at = rng.randrange(200)
        docs.append((i, " ".join(filler[:at] + changed + answer + filler[at:])))
    docs += [(100 + i, " ".join(rng.choices(common, k=150))) for i in range(60)]
    want = brute_force(docs, items)
    have = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items)}
    assert len(want) >= 30 and have == want


def test_recall_on_given_tables(spark, data_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    items = [(i, t) for i, t in items if len(words_of(t.encode())) <= dc.PIECE]
    exact = {(d, i) for d, text in docs for i, t in items if t in text}
    have = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items)}
    assert exact <= have
    holders = {d for d, _ in exact}
    assert len({d for d, _ in have} - holders) <= 0.02 * len(docs)


def test_small_blocks_give_the_same(spark):
    docs, items = corpus(3)
    whole = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items)}
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    parts = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(df, bench, block=7).collect()}
    assert parts == whole


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda mu"
    long_item = " ".join(f"k{i}" for i in range(200))
    items = [(1, item), (2, item), (3, None), (4, ""), (5, "too few words"), (None, "one two three four five six seven eight nine ten"), (7, long_item)]
    docs = [
        (1, None), (2, ""), (3, item.upper()), (4, "x " * 40_000 + item + " y" * 1000), (5, "too few words"),
        (None, item), (3, item), (6, "one two three four five six seven eight nine ten"),
        (7, "z " * 50 + " ".join(long_item.split()[60:140])),
    ]
    have = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items)}
    assert have == {(d, i) for d in (3, 4, None) for i in (1, 2)} | {(6, None), (7, 7)}
    rows = found(spark, docs, items)
    assert sum(r["doc_id"] == 3 for r in rows) == 4
    assert found(spark, docs[:0], items) == [] and found(spark, docs, items[:0]) == []
    assert found(spark, docs, items[2:5]) == []
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'k' as lang")
    kept = dc.without_leaks(df, spark.createDataFrame(items, ITEMS))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5", "None"] and kept.columns == df.columns


def test_bit_parallel_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = (["w%d" % rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert dc.common_subsequence([x.encode() for x in a], [x.encode() for x in b]) == plain_lcs(a, b)


def test_stages_in_order():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert all(callable(f) for _, f in corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over sf0.01."""
    folder, out = "/root/testdata/sf0.01", []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        result = corpus_pipeline.checkpointed(stage(spark, docs, folder), name)
        out.append((docs, result))
        docs = result
    return out


def test_quality_stage_keeps_clean_documents(spark, stages):
    before, after = stages[0]
    assert after.columns == before.columns
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = after.select("doc_id").withColumn("kept", F.lit(True))
    rows = labels.join(before, "doc_id", "left_semi").join(kept, "doc_id", "left").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(map(bool, good)) >= 0.99 * len(good) and sum(map(bool, bad)) <= 0.1 * len(bad)


def test_duplicate_stage_equals_brute_force(stages):
    from tests.llm.test_partenum import shingles

    before, after = stages[1]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    sets = {d: shingles(t, 5) for d, t in rows}
    index, root = {}, {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for other, same in _overlaps(index, s).items():
            if same * 100 >= 80 * (len(s) + len(sets[other]) - same):
                a, b = find(d), find(other)
                root[max(a, b)] = min(a, b)
        for x in s:
            index.setdefault(x, []).append(d)
    assert sorted(r["doc_id"] for r in after.collect()) == [d for d in sets if find(d) == d]


def _overlaps(index, shingle_set):
    out = {}
    for x in shingle_set:
        for d in index.get(x, ()):
            out[d] = out.get(d, 0) + 1
    return out


def test_leak_stage_drops_documents_with_items(spark, stages):
    before, after = stages[2]
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    dropped = before.join(after, "doc_id", "left_anti").collect()
    assert not [r["doc_id"] for r in after.collect() if any(t in r["text"] for t in items)]
    assert dropped and len(dropped) < 0.1 * before.count()


def test_mixing_and_sharding_stages(stages):
    from lexiframe.llm.mixing import mix

    before, after = stages[3]
    want = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mix(before).where("taken > 0").collect()}
    have = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert have == want and after.columns == before.columns
    before, after = stages[4]
    assert after.count() == before.count() and {r["law"] for r in after.select("law").distinct().collect()} == {"rows"}


def test_a_basis_is_found_with_little_memory():
    """Numpy factors a whole matrix with several copies in double precision on the driver."""
    rng = np.random.default_rng(1)
    columns = rng.standard_normal((1 << 14, 256)).astype(np.float32)
    columns[:, 200:] = columns[:, :56]  # not all independent
    tracemalloc.start()
    basis = dc.orthonormal(columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * columns.nbytes  # 5 times before
    assert np.abs(basis.T @ basis - np.eye(256)).max() < 1e-4
    assert np.abs(basis @ (basis.T @ columns) - columns).max() < 1e-3
    few = rng.standard_normal((100, 256)).astype(np.float32)
    assert (dc.orthonormal(few) == np.linalg.qr(few)[0]).all()
