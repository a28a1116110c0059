"""Hashed embedding against plain Python."""

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexiframe.functions.text import WHITESPACE, words
from lexiframe.operators import chunks


def plain(text, dim):
    counts = np.zeros(dim)
    for w in (text or "").lower().split():
        counts[int(md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    norm = np.sqrt((counts**2).sum()) or 1.0
    return (counts / norm).astype(np.float32).tolist()


TEXTS = [
    None, "", " ", "one", "One ONE two", "  Éa éA　 x\x1cy\x1fz ", WHITESPACE, f"a{WHITESPACE}b",
    "x " * 3000, " ".join(f"w{i}" for i in range(5000)), "zero​width ᠎ no­break", "日本 語 日本",
]


def test_embedding_counts_the_words_of_a_text(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for step in (chunks._BYTES_PER_STEP, 1, 100):
        monkeypatch.setattr(chunks, "_BYTES_PER_STEP", step)
        for dim in (64, 7):
            rows = chunks.hash_embed(df.coalesce(1), dim=dim).collect()
            assert {r.i: r.embedding for r in rows} == {i: plain(t, dim) for i, t in enumerate(TEXTS)}
    nothing = chunks.hash_embed(df.where("i < 3"), dim=2).collect()
    assert [r.embedding for r in nothing] == [[0.0, 0.0]] * 3


def test_words_end_at_the_same_characters(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "i int, text string")
    for r in chunks.hash_embed(df.withColumn("w", words(F.lower("text")))).collect():
        assert r.embedding == plain(" ".join(r.w), 64), hex(r.i)


def test_a_word_that_comes_often_is_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(chunks, "md5", lambda t, **k: hashed.append(t) or md5(t, **k))
    found = chunks.token_buckets(pa.array(["b", "a", "", "b"] * 1000 + ["c"]), 64)
    assert sorted(hashed) == [b"", b"a", b"b", b"c"]
    want = [int(md5(w).hexdigest()[:8], 16) % 64 for w in (b"b", b"a")]
    assert found[:4].tolist() == [*want, -1, want[0]] and len(found) == 4001
    assert chunks.token_buckets(pa.array([], pa.string()), 64).tolist() == []
