"""Fusion against its closed form in SQL, and the quirks it must keep."""

import random

import duckdb
import pyarrow as pa

from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.operators.fuse import default_if_unset, format_results, fuse
from lexiframe.plans.answer import failed_questions, search_lists

HITS = (
    "query_id bigint, list_type string, list_prio int, sub_query int, rank int,"
    " chunk_id string, similarity double"
)


def random_hits(rng, questions):
    rows = []
    for q in range(questions):
        ids = [f"c{i}" for i in range(rng.randint(8, 40))]
        lists = [] if rng.random() < 0.2 else [(fixed.LEGAL, 0, 0, 10)]
        lists += [(fixed.ORIGINAL, 1, 0, 10)]
        lists += [(fixed.ADDITIONAL, 2, i, 5) for i in range(rng.randint(0, 3))]
        for kind, prio, sub, k in lists:
            found = rng.sample(ids, min(k, len(ids)))
            rows += [(q, kind, prio, sub, r + 1, c, 0.5) for r, c in enumerate(found)]
    return rows


CLOSED_FORM = """
WITH placed AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_prio, sub_query, rank) AS pos FROM hits),
kept AS (
    SELECT query_id, list_type, chunk_id, pos FROM placed
    QUALIFY NOT {dedupe} OR pos = min(pos) OVER (PARTITION BY query_id, chunk_id)),
parts AS (
    SELECT *, row_number() OVER (PARTITION BY query_id, list_type ORDER BY pos) AS place FROM kept),
scores AS (
    SELECT query_id, chunk_id, min(pos) AS pos, sum(weight / (60 + place)) AS score
    FROM parts JOIN weights USING (list_type) GROUP BY ALL)
SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) <= {top_k}
ORDER BY query_id, scores.score DESC, pos
"""


def oracle(rows, top_k, dedupe):
    """Scores from the positions in the lists, in SQL."""
    names = [c.split()[0] for c in HITS.split(", ")]
    con = duckdb.connect()
    con.register("hits", pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))))
    kinds = list(fixed.LIST_WEIGHTS.items())
    con.register("weights", pa.table({"list_type": [k for k, _ in kinds], "weight": [float(w) for _, w in kinds]}))
    out = {}
    for query, chunk, score in con.execute(CLOSED_FORM.format(dedupe=str(dedupe).lower(), top_k=top_k)).fetchall():
        out.setdefault(query, []).append((chunk, round(score, 9)))
    return out


def fused(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
    return out


def test_first_hit_equals_sequential_fusion(spark):
    rows = random_hits(random.Random(11), 200)
    df = spark.createDataFrame(rows, HITS).repartition(4)
    assert fused(fuse(df, top_k=20)) == oracle(rows, 20, True)
    # with a full legal list the default answer is its top five
    five = fused(fuse(df))
    legal = {}
    for r in rows:
        if r[1] == fixed.LEGAL and r[4] <= 5:
            legal.setdefault(r[0], []).append(r[5])
    assert all([c for c, _ in five[q]] == ids for q, ids in legal.items())


def test_textbook_sums_over_lists(spark):
    rows = random_hits(random.Random(12), 100)
    got = fused(fuse(spark.createDataFrame(rows, HITS), fusion="rrf", top_k=20))
    want = oracle(rows, 20, False)
    assert {q: sorted(s for _, s in v) for q, v in got.items()} == {
        q: sorted(s for _, s in v) for q, v in want.items()
    }


def test_threshold_and_minimum_similarity(spark):
    rows = [(1, fixed.LEGAL, 0, 0, 1, "a", 0.9), (1, fixed.LEGAL, 0, 0, 2, "b", 0.1)]
    df = spark.createDataFrame(rows, HITS)
    assert len(fused(fuse(df))[1]) == 2  # the score threshold drops nothing
    assert fused(fuse(df, min_cosine=0.3)) == {1: [("a", 1.0)]}
    assert fused(fuse(df, threshold=0.99)) == {1: [("a", 1.0)]}


def test_defaults(spark):
    hit = spark.createDataFrame([(1, fixed.LEGAL, 0, 0, 1, "gone", 0.5)], HITS)
    chunks = spark.createDataFrame(
        [],
        "chunk_id string, source string, article_number bigint, paragraph_number bigint,"
        " chunk_type string, text string",
    )
    row = format_results(fuse(hit), chunks).first()
    assert (row.source, row.chunk_type, row.text, row.article_number) == ("", "body", "", None)
    values = spark.createDataFrame([(None,), (0,), (3,)], "k int")
    got = values.select(default_if_unset(F.col("k"), 5).alias("k")).collect()
    assert [r.k for r in got] == [5, 5, 3]


def test_failed_additional_search_is_skipped_but_failed_legal_fails(spark):
    rows = [
        (1, fixed.LEGAL, 0, 0, 10, [1.0, 0.0]),
        (1, fixed.ORIGINAL, 1, 0, 10, [0.0, 1.0]),
        (1, fixed.ADDITIONAL, 2, 0, 5, None),
        (2, fixed.LEGAL, 0, 0, 10, None),
        (2, fixed.ORIGINAL, 1, 0, 10, [0.0, 1.0]),
    ]
    searches = spark.createDataFrame(
        rows,
        "query_id bigint, list_type string, list_prio int, sub_query int, k int,"
        " embedding array<float>",
    )
    chunks = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>"
    )
    lists = search_lists(searches, chunks).select("query_id", "list_type").distinct().collect()
    assert {tuple(r) for r in lists} == {
        (1, fixed.LEGAL),
        (1, fixed.ORIGINAL),
        (2, fixed.ORIGINAL),
    }
    assert [r.query_id for r in failed_questions(searches).collect()] == [2]


def test_searches_of_equal_vectors_are_one_query(spark):
    kinds = [(fixed.LEGAL, 0, 0, 2), (fixed.ORIGINAL, 1, 0, 2), (fixed.ADDITIONAL, 2, 0, 1)]
    rows = [(q, *kind, [1.0, 0.0] if q < 8 else [0.0, 1.0]) for q in range(10) for kind in kinds]
    rows.append((9, *kinds[0], [0.0, 1.0]))  # a search that comes twice: its hits are one list of two
    searches = spark.createDataFrame(
        rows, "query_id bigint, list_type string, list_prio int, sub_query int, k int, embedding array<float>"
    )
    chunks = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<float>"
    )
    asked = []

    def search(keyed, k, where):
        asked.append(keyed.count())
        q = keyed.select("search", F.col("embedding").alias("v"))
        near = F.round(F.aggregate(F.zip_with("v", "embedding", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 9)
        return q.crossJoin(chunks).select("search", "chunk_id", near.alias("similarity"), F.lit(1).alias("rank"))

    for found in (search_lists(searches, chunks), search_lists(searches, None, search=search)):
        lists = {}
        for r in found.orderBy("rank").collect():
            lists.setdefault((r.query_id, r.list_prio), []).append(r.chunk_id)
        for q in range(10):
            best = ["a", "b"] if q < 8 else ["c", "b"]
            assert lists[q, 0] == (["c", "c"] if q == 9 else best)
            assert lists[q, 1] == best and lists[q, 2] == best[:1]
    assert asked == [2]
