"""Top-k joins against brute force, on both execution paths."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiframe.functions import topk
from lexiframe.operators.ivf import knn_ivf, recall_against, train_cells, with_cell
from lexiframe.operators.keyword import bm25, containing
from lexiframe.operators.knn import knn
from lexiframe.operators.topk_join import SCORED_BYTES, grid_shape


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    data[40:60] = data[40]  # exact copies: ties go to the smaller id
    data[7] = 0
    return data


def frame(spark, data, key):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>").repartition(5)


def brute(data, queries, k):
    d = data.astype(np.float64)
    norm = np.linalg.norm(d, axis=1, keepdims=True)
    norm[norm == 0] = 1
    unit = d / norm
    sims = np.round(unit[queries] @ unit.T, 9)
    out = {}
    for q, row in zip(queries, sims):
        order = sorted(range(len(d)), key=lambda i: (-row[i], i))[:k]
        out[q] = [(r + 1, i) for r, i in enumerate(order)]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    return out


@pytest.mark.parametrize(
    "limits", [{}, {"broadcast_rows": 0, "cell_queries": 40, "cell_rows": 70}]
)
def test_knn_equals_brute_force(spark, vectors, limits):
    found = knn(frame(spark, vectors, "query_id"), frame(spark, vectors, "chunk_id"), 10, **limits)
    assert collected(found) == brute(vectors, list(range(300)), 10)


def test_a_third_of_the_chunks_are_copies(spark):
    data = np.random.default_rng(9).normal(size=(600, 4)).astype(np.float32)
    data[100:300] = data[100]
    found = knn(frame(spark, data, "query_id"), frame(spark, data, "chunk_id"), 10)
    assert collected(found) == brute(data, list(range(600)), 10)


def test_string_ids(spark, vectors):
    chunks = frame(spark, vectors[40:60], "chunk_id").withColumn(
        "chunk_id", F.concat(F.lit("c"), F.col("chunk_id"))
    )
    found = knn(frame(spark, vectors[:1], "query_id"), chunks, 3)  # all copies
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == ["c0", "c1", "c10"]


def test_fewer_chunks_than_k(spark, vectors):
    found = knn(frame(spark, vectors[:4], "query_id"), frame(spark, vectors[:3], "chunk_id"), 10)
    assert {q: len(v) for q, v in collected(found).items()} == {0: 3, 1: 3, 2: 3, 3: 3}


def test_null_embedding_returns_nothing(spark, vectors):
    queries = frame(spark, vectors[:2], "query_id").withColumn(
        "embedding", F.when(F.col("query_id") == 0, F.col("embedding"))
    )
    assert set(collected(knn(queries, frame(spark, vectors, "chunk_id"), 3))) == {0}


def test_ivf_with_all_probes_is_exact_and_fewer_probes_keep_recall(spark, vectors):
    queries, chunks = frame(spark, vectors, "query_id"), frame(spark, vectors, "chunk_id")
    centres = train_cells(chunks, 6)
    indexed = with_cell(chunks, centres)
    full = knn_ivf(queries, indexed, centres, 10, probes=6, cell_queries=50, cell_rows=30)
    assert collected(full) == brute(vectors, list(range(300)), 10)
    some = knn_ivf(queries, indexed, centres, 10, probes=3)
    recall = recall_against(some, knn(queries, chunks, 10)).first()
    assert recall.neighbours == 3000 and recall.recall > 0.6


def test_bm25_paths_agree(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 25)))) for i in range(120)]
    asked = [(i, " ".join(rng.choice(vocabulary, 4)) + " unknown") for i in range(25)]
    docs = spark.createDataFrame(texts, "chunk_id bigint, text string").repartition(4)
    questions = spark.createDataFrame(asked, "query_id bigint, search_text string")
    small = bm25(questions, docs, 5).collect()
    grid = bm25(questions, docs, 5, broadcast_rows=0, cell_queries=6, cell_rows=30).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, grid))

    tokens = {i: t.split() for i, t in texts}
    mean = np.mean([len(t) for t in tokens.values()])
    want = {}
    for q, text in asked:
        scores = {}
        for term in set(text.split()):
            df = sum(term in t for t in tokens.values())
            if df:
                idf = np.log1p((len(tokens) - df + 0.5) / (df + 0.5))
                for d, t in tokens.items():
                    tf = t.count(term)
                    if tf:
                        weight = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
                        scores[d] = scores.get(d, 0) + idf * weight
        best = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:5]
        want[q] = [(r + 1, d) for r, d in enumerate(best)]
    assert collected(spark.createDataFrame(small)) == want


def test_containing_paths_agree(spark):
    texts = ["xx The. b c", "aThe.b Was andx", "one two  three", "one two three four", ""]
    asked = ["The.", "s and", "two three", "one two three", "ne two thr", " two ", "zzz", "e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string")
    questions = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, search_text string")
    want = {(q, d) for q, p in enumerate(asked) for d, t in enumerate(texts) if p in t}
    for limit in (100, 0):
        rows = containing(questions, docs, literal_patterns=limit).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("vectors", [[[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]], [None, [1.0, 2.0, 3.0, 4.0]]])
def test_uneven_or_missing_vectors_raise(vectors):
    import pyarrow as pa

    from lexiframe.functions.topk import array_matrix

    with pytest.raises(ValueError, match="differ in length"):
        array_matrix(pa.array(vectors, pa.list_(pa.float32())))


class Counting(topk.CosineScorer):
    """Counts the scores that are computed in full."""

    exact = 0

    def score(self, state, rows, lo, hi):
        self.exact += (hi - lo) * len(rows)
        return super().score(state, rows, lo, hi)

    def pairs(self, state, rows, r, c):
        self.exact += len(r)
        return super().pairs(state, rows, r, c)


@pytest.mark.parametrize("names", [lambda i: i, lambda i: f"c{i:05}"])
def test_few_pairs_are_scored_in_full_and_none_is_lost(names):
    rng = np.random.default_rng(17)
    rows = np.abs(rng.normal(size=(20_000, 24))).astype(np.float32)
    rows[3_000:5_000] = rows[2_999]  # copies: every one ties with the best of its queries
    rows[9_000:9_010] = rows[9_000] * (1 + 1e-7)  # closer to each other than single precision shows
    rows[100:110], rows[200] = 0, np.nan
    asked = np.concatenate([rows[2_999:3_000], rows[9_000:9_001], rows[100:102], rows[200:201], rows[6_000:6_300]])

    def lists(matrix):
        return pa.array(list(matrix), pa.list_(pa.float32()))

    order = rng.permutation(len(rows))
    table = pa.table({"id": [names(int(i)) for i in order], "c": lists(rows[order])})
    scorer = Counting("q", "c")
    state = scorer.prepare(pa.table({"q": lists(asked)}))
    r, s, ids = topk.best_rows(scorer, state, len(asked), table.to_batches(4_096), "id", 10)
    with np.errstate(invalid="ignore"):
        sims = np.round(topk.unit_rows(asked.astype(float)) @ topk.unit_rows(rows.astype(float)).T, 9)
    for q in range(len(asked)):
        found = np.flatnonzero(~np.isnan(sims[q]))
        best = found[np.lexsort((found, -sims[q][found]))][:10]
        assert list(ids[r == q]) == [names(int(i)) for i in best]
        assert np.array_equal(s[r == q], sims[q][best])
    assert scorer.exact < len(asked) * len(rows) / 4


def test_the_grid_has_cells_for_all_cores_and_they_do_not_grow():
    bound = SCORED_BYTES // 264
    for rows in (100_000, 600_000):
        stripes, columns = grid_shape(rows, rows, bound, bound, 12)
        assert stripes * columns >= 40
        assert rows / stripes <= bound and rows / columns <= bound
    assert grid_shape(1_000, 1_000, bound, bound, 12) == (1, 1)
    assert grid_shape(0, 0, bound, bound, 12) == (1, 1)
