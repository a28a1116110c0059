"""Inverted index against plain scoring, its pruning, and text search without pairs."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiframe.operators.keyword import search_by_text
from lexiframe.sources import postings
from lexiframe.sources.postings import PostingsIndex

DOCS = "chunk_id string, text string"


def corpus(seed, many=400):
    """Frequent and rare words, copies, empty and null texts, repeated and null ids."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(f"c{i:03}", " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 60])))) for i in range(many)]
    docs += [("c001", docs[1][1]), ("c002", "w5 W5, w7"), (None, "w9 w9 w1"), ("e", None), ("f", " . ")]
    docs += [(f"x{i}", "w0 w1 w2 w50") for i in range(30)]
    asked = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 12])))) for i in range(40)]
    asked += [(100, "unknown"), (101, None), (102, ""), (103, "W5-w5 unknown"), (104, "w1 w9"), (104, "w9 w3"), (105, docs[2][1])]
    return docs, asked


def plain(docs, asked, k):
    tokens = [re.findall("[a-z0-9]+", (t or "").lower()) for _, t in docs]
    n, mean = len(docs), sum(map(len, tokens)) / len(docs)
    df = collections.Counter(w for t in tokens for w in set(t))
    questions = collections.defaultdict(set)
    for q, text in asked:
        questions[q] |= set(re.findall("[a-z0-9]+", (text or "").lower()))
    out = set()
    for q, terms in questions.items():
        found = []
        for (doc, _), t in zip(docs, tokens, strict=True):
            count = collections.Counter(t)
            parts = [
                math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * count[w] * 2.2 / (count[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
                for w in terms if count[w]
            ]
            if parts:
                found.append((-round(sum(parts), 9), doc is not None, doc or ""))
        for rank, (score, known, doc) in enumerate(sorted(found)[:k]):
            out.add((q, doc if known else None, round(-score, 6), rank + 1))
    return out


@pytest.mark.parametrize("seed,segment,stripe,k", [(1, 64, 1 << 18, 10), (3, 4096, 20, 3)])
def test_search_equals_plain_scoring(spark, tmp_path, seed, segment, stripe, k):
    docs, asked = corpus(seed)
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    index = PostingsIndex.build(spark, str(tmp_path / "p"), df, segment_docs=segment, buckets=4)
    questions = spark.createDataFrame(asked, "query_id int, search_text string")
    rows = index.search(questions, k, stripe_terms=stripe).collect()
    got = {(r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in rows}
    assert got == plain(docs, asked, k) and len(rows) == len(got)


def test_most_postings_of_frequent_words_stay_unread(spark, tmp_path, monkeypatch):
    """A rare pair of words finds its documents; the blocks of the frequent one are read where they are."""
    docs = [(f"d{i:04}", f"common filler{i % 7} more" + (" rare special" if i % 400 < 12 else "")) for i in range(4000)]
    df = spark.createDataFrame(docs, DOCS).repartitionByRange(1, "chunk_id")
    index = PostingsIndex.build(spark, str(tmp_path / "p"), df, segment_docs=100, buckets=4)
    blocks = index.blocks()
    assert blocks.where("term = 'common'").count() == 40
    seen = []
    needed = PostingsIndex._needed

    def spy(self, wanted):
        out = needed(self, wanted)
        seen.append(out)
        return out

    monkeypatch.setattr(PostingsIndex, "_needed", spy)
    found = index.search(spark.createDataFrame([(1, "common rare special")], "query_id int, search_text string"), 10)
    assert [r["rank"] for r in found.collect()] == list(range(1, 11))
    read = [{r.term: r["count"] for r in b.groupBy("term").count().collect()} for b in seen]
    assert "common" not in read[0] and "common" not in read[1]  # not essential
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PartitionFilters" in plan


def test_empty_index_and_versions(spark, tmp_path):
    path = str(tmp_path / "p")
    questions = spark.createDataFrame([(1, "b")], "query_id int, search_text string")
    empty = PostingsIndex.build(spark, path, spark.createDataFrame([], DOCS))
    assert empty.search(questions).collect() == []
    full = PostingsIndex.build(spark, path, spark.createDataFrame([("x", "a b")], DOCS))
    assert [r.chunk_id for r in full.search(questions).collect()] == ["x"]
    assert PostingsIndex(spark, path, version=1).search(questions).collect() == []
    full.table.expire(keep=1)
    assert full.table.versions() == [2] and [r.chunk_id for r in full.search(questions).collect()] == ["x"]


def test_tokens_are_counted_once(spark, tmp_path):
    """The index is built from one scan of the texts."""
    counter = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        counter.add(1)
        return text

    docs = spark.createDataFrame([(f"d{i}", "a b c") for i in range(50)], DOCS)
    PostingsIndex.build(spark, str(tmp_path / "p"), docs.withColumn("text", seen.asNondeterministic()("text")))
    assert counter.value == 50


@pytest.mark.parametrize("max_bytes", [1 << 25, 200])
def test_text_search_keeps_the_nearest(spark, max_bytes):
    rng = random.Random(4)
    vector = lambda: [float(rng.randint(-3, 3)) for _ in range(3)]
    docs = [(i, rng.choice(["a b c", "xa by", "", "bb ab", None]), vector()) for i in range(200)] + [(500, "a b", None)]
    asked = [(0, "a"), (1, "b c"), (2, ""), (3, "zz"), (4, "a"), (5, None), (None, "by")]
    asked = [(q, t, vector()) for q, t in asked] + [(9, "a", None)]
    schema = "text string, embedding array<float>"
    got = search_by_text(
        spark.createDataFrame(asked, "query_id int, search_text string, embedding array<float>"),
        spark.createDataFrame(docs, f"chunk_id int, {schema}").repartition(4),
        5,
        max_bytes=max_bytes,
    ).collect()
    want = set()
    for q, t, v in asked:
        if t is None or v is None:
            continue
        found = []
        for d, text, u in docs:
            if text is not None and u is not None and t in text:
                size = math.sqrt(sum(x * x for x in v) * sum(x * x for x in u))
                found.append((-round(sum(x * y for x, y in zip(u, v, strict=True)) / size, 9) if size else 0.0, d))
        want |= {(q, d, i + 1) for i, (_, d) in enumerate(sorted(found)[:5])}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == want


def test_segment_blocks_hold_places_by_id(spark):
    import pyarrow as pa

    kinds = [("segment", pa.int64()), ("term", pa.string()), *((n, pa.list_(pa.int32())) for n in ("at", "tf", "len"))]
    schema = pa.schema([*kinds, ("ids", pa.list_(pa.string()))])
    tokens = pa.array([["b", "a", "b"], [], ["a"]], pa.list_(pa.string()))
    rows = postings.segment_blocks(pa.array(["z", "m", None]), tokens, 7, schema).to_pylist()
    assert rows[0] == {"segment": 7, "term": None, "at": None, "tf": None, "len": [1, 0, 3], "ids": [None, "m", "z"]}
    by_term = {r["term"]: (r["at"], r["tf"], r["len"]) for r in rows[1:]}
    assert by_term == {"a": ([0, 2], [1, 1], [1, 3]), "b": ([2], [2], [3])}


def test_a_segment_is_counted_in_little_memory():
    """It took more than five arrays of a number per token; dictionary codes give the same blocks as strings."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    number = pa.list_(pa.int32())
    schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("at", number), ("tf", number), ("len", number), ("ids", pa.list_(pa.int64()))])
    many, width = 1_024, 1_024
    words = pa.array([f"t{i}" for i in range(500)]).take(pa.array(np.random.default_rng(0).integers(0, 500, many * width)))
    offsets = pa.array(np.arange(many + 1) * width, pa.int32())
    ids = pa.array(np.arange(many)[::-1].copy())
    strings, codes = (pa.ListArray.from_arrays(offsets, x) for x in (words, words.dictionary_encode()))
    want = postings.segment_blocks(ids, strings, 3, schema)
    tracemalloc.start()
    have = postings.segment_blocks(ids, codes, 3, schema)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert have.to_pylist() == want.to_pylist() and peak < 3.5 * 8 * many * width
