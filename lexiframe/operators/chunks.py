"""Chunk table: ids, metadata, token windows, embeddings and their checks."""

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.functions import fixed
from lexiframe.functions.text import words

HASH_DIM = 64
WINDOW_TOKENS = 300
WINDOW_OVERLAP = 30
VECTOR = T.ArrayType(T.FloatType())
_BYTES_PER_STEP = 1 << 21  # of text that is cut and counted at once


def chunk_id(article, paragraph, chunk_type) -> Column:
    """``art{article}[_p{paragraph}]_{type}``; paragraph 0 counts as none."""
    part = F.when(
        F.col(paragraph).isNotNull() & (F.col(paragraph) != 0),
        F.concat(F.lit("_p"), F.col(paragraph)),
    ).otherwise("")
    return F.concat(F.lit("art"), F.col(article), part, F.lit("_"), F.col(chunk_type))


def stack_sections(body: DataFrame, elucidation: DataFrame) -> DataFrame:
    """UNION ALL of both section types, tagged with ``chunk_type``."""
    return body.withColumn("chunk_type", F.lit(fixed.BODY)).unionByName(
        elucidation.withColumn("chunk_type", F.lit(fixed.ELUCIDATION))
    )


def to_chunks(segments: DataFrame, source: str = fixed.STATUTE_SOURCE) -> DataFrame:
    """Chunk rows with flat metadata columns; an absent paragraph stays null.

    With a ``doc_id`` column it is kept, and ids begin with ``doc{doc_id}_`` where it is set.
    """
    name, document = chunk_id("article_number", "paragraph_number", "chunk_type"), []
    if "doc_id" in segments.columns:
        prefix = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("doc"), "doc_id", F.lit("_")))
        name = F.concat(F.coalesce(prefix, F.lit("")), name)
        document = ["doc_id"]
    return segments.select(
        name.alias("chunk_id"),
        *document,
        F.lit(source).alias("source"),
        F.col("article_number").cast("bigint").alias("article_number"),
        F.col("paragraph_number").cast("bigint").alias("paragraph_number"),
        "chunk_type",
        "text",
    )


def colliding_ids(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunk ids used by more than one row."""
    return chunks.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def token_windows(
    docs: DataFrame,
    text: str = "text",
    size: int = WINDOW_TOKENS,
    overlap: int = WINDOW_OVERLAP,
) -> DataFrame:
    """Overlapping token windows; the last one never lies inside the one before it."""
    step = size - overlap
    others = [c for c in docs.columns if c != text]
    tokens = docs.select(*others, words(F.col(text)).alias("_t"))
    count = F.size("_t")
    last = F.ceil(F.greatest(count - size, F.lit(0)) / step).cast("int")
    # no filter on the tokens: it would be pushed down and split every text twice
    numbers = F.when(count > 0, F.sequence(F.lit(0), last))
    windows = tokens.select(*others, "_t", F.explode(numbers).alias("chunk_index"))
    piece = F.slice("_t", F.col("chunk_index") * step + 1, F.lit(size))
    return windows.withColumn("_p", piece).select(
        *others,
        "chunk_index",
        F.size("_p").alias("token_count"),
        F.array_join("_p", " ").alias(text),
    )


def token_buckets(tokens: pa.Array, dim: int = HASH_DIM) -> np.ndarray:
    """Bucket number of every token, from the first 32 bits of its MD5, and -1 for an empty one.

    Every different token is hashed once.
    """
    coded = tokens.dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_pylist()
    first = b"".join([md5(t, usedforsecurity=False).digest()[:4] for t in different])
    buckets = (np.frombuffer(first, ">u4") % dim).astype(np.int64)
    buckets[[i for i, t in enumerate(different) if not t]] = -1
    return buckets[coded.indices.to_numpy(zero_copy_only=False)]


def hash_embed(
    df: DataFrame, text: str = "text", dim: int = HASH_DIM, name: str = "embedding"
) -> DataFrame:
    """Deterministic embedding without a model: hashed token counts, unit length.

    Texts are lower-cased in the JVM, cut and counted by vectorised steps within an Arrow batch; a step hashes
    every different token once.  Nothing is shuffled, and an unused embedding is pruned.
    """
    @F.arrow_udf(VECTOR)
    def embed(texts: pa.Array) -> pa.Array:
        n = len(texts)
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(size, dtype=np.int64))
        counts, at = np.empty((n, dim), np.int64), 0
        while at < n:  # a row at least
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + _BYTES_PER_STEP, side="right")) - 1)
            tokens = pc.utf8_split_whitespace(texts.slice(at, stop - at))
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            buckets = token_buckets(tokens.flatten(), dim)
            cells = (np.repeat(np.arange(stop - at) * dim, lengths) + buckets)[buckets >= 0]
            counts[at:stop] = np.bincount(cells, minlength=(stop - at) * dim).reshape(-1, dim)
            at = stop
        norm = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1))
        norm[norm == 0] = 1.0
        unit = (counts / norm[:, None]).astype(np.float32).ravel()
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(unit))

    return df.withColumn(name, _once(embed)(F.lower(F.col(text))))


def embed_with(
    df: DataFrame,
    embed_fn,
    text: str = "text",
    batch_size: int = fixed.EMBED_BATCH,
    name: str = "embedding",
) -> DataFrame:
    """Embed through a user function ``list[str] -> list[vector]`` in batches.

    A batch that raises fails its task; Spark retries it and then aborts the write.
    """
    @F.pandas_udf(VECTOR)
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(texts), batch_size):
            part = texts.iloc[start : start + batch_size].tolist()
            vectors = [np.asarray(v, dtype=np.float32) for v in embed_fn(part)]
            if len(vectors) != len(part):
                raise ValueError("embed_fn must return one vector per text")
            out += vectors
        return pd.Series(out, dtype=object)

    return df.withColumn(name, _once(embed)(F.col(text)))


def _once(udf):
    """Keep the planner from repeating the function below filters on its result."""
    return udf.asNondeterministic()


def wrong_dimension(chunks: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector does not have the expected width."""
    return chunks.where(
        F.col(embedding).isNull() | (F.size(embedding) != dim)
    )
