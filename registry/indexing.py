"""Chunk table queries: JSON lines, index sinks, embeddings, token windows."""

from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.operators.chunks import (
    HASH_DIM,
    embed_with,
    hash_embed,
    stack_sections,
    to_chunks,
    token_windows,
    wrong_dimension,
)
from lexiframe.plans.statutes import index_health, ingest
from lexiframe.session import scratch_path
from lexiframe.sources.index import (
    append_chunks,
    bootstrap_index,
    index_history,
    read_index,
    rebuild_index,
    scan_index,
    truncate_index,
)
from lexiframe.sources.jsonl import read_jsonl, write_jsonl
from registry.common import CHUNKS_SQL, document_segments, sql_embeddings, sql_words, table


def _jsonl_files(spark, folder):
    """Both JSON lines files of the documents."""
    segments = document_segments(spark, folder)
    paths = {}
    for kind in (fixed.BODY, fixed.ELUCIDATION):
        paths[kind] = scratch_path(spark, kind)
        write_jsonl(segments.where(F.col("chunk_type") == kind).drop("chunk_type"), paths[kind])
    return paths


def _metadata(chunks, *more):
    return chunks.select(
        "chunk_id",
        "source",
        "article_number",
        F.coalesce("paragraph_number", F.lit(0).cast("bigint")).alias("paragraph_number"),
        "chunk_type",
        F.md5("text").alias("text_md5"),
        *more,
    )


def jsonl_roundtrip(spark, folder):
    paths = _jsonl_files(spark, folder)
    return stack_sections(
        read_jsonl(spark, paths[fixed.BODY]), read_jsonl(spark, paths[fixed.ELUCIDATION])
    ).select(
        "article_number",
        F.coalesce("paragraph_number", F.lit(0).cast("bigint")).alias("paragraph_number"),
        "chunk_type",
        "text",
    )


def _ingested(spark, folder):
    paths = _jsonl_files(spark, folder)
    index = scratch_path(spark, "index")
    ingest(spark, paths[fixed.BODY], paths[fixed.ELUCIDATION], index, HASH_DIM)
    return index


def ingest_chunks(spark, folder):
    chunks = read_index(spark, _ingested(spark, folder))
    return _metadata(chunks, "text")


def ingest_append(spark, folder):
    """Bodies first, then everything twice: only the missing chunks are added."""
    index = scratch_path(spark, "index")
    chunks = to_chunks(document_segments(spark, folder))
    rebuild_index(chunks.where(F.col("chunk_type") == fixed.BODY), index)
    append_chunks(chunks, index)
    append_chunks(chunks, index)
    return _metadata(read_index(spark, index))


def index_versions(spark, folder):
    """What every version of an index holds; all are read after the last one was written.

    1 bodies, 2 the missing chunks appended, 3 nothing (a repeated append), 4 truncated, 5 rebuilt
    with elucidations; the bootstraps in between change nothing.
    """
    index = scratch_path(spark, "index")
    chunks = to_chunks(document_segments(spark, folder))
    bootstrap_index(chunks.where(F.col("chunk_type") == fixed.BODY), index)
    append_chunks(chunks, index)
    append_chunks(chunks, index)
    bootstrap_index(chunks, index)
    truncate_index(spark, index)
    bootstrap_index(chunks, index)
    rebuild_index(chunks.where(F.col("chunk_type") == fixed.ELUCIDATION), index)
    versions = index_history(spark, index)
    rows = None
    for version in range(1, 6):
        ids = read_index(spark, index, version).select(F.lit(version).cast("bigint").alias("version"), "chunk_id")
        rows = ids if rows is None else rows.unionByName(ids)
    return versions.join(rows, "version", "left").select("version", "operation", "folders", "chunks", "chunk_id")


def scan_chunks(spark, folder):
    return _metadata(scan_index(spark, _ingested(spark, folder)))


def index_stats(spark, folder):
    return index_health(spark, _ingested(spark, folder))


def dim_check(spark, folder):
    """Vectors per label that are not 64 wide; some are cut, some missing."""
    cut = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 11 != 0, F.col("embedding"))
    vectors = table(spark, folder, "embeddings").withColumn("embedding", cut)
    bad = wrong_dimension(vectors, HASH_DIM).groupBy("label").agg(F.count("*").alias("wrong"))
    return (
        vectors.groupBy("label")
        .agg(F.count("*").alias("vectors"))
        .join(bad, "label", "left")
        .fillna(0, ["wrong"])
    )


def embed_documents(spark, folder):
    """Non-zero components of the hashed embedding of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return (
        hash_embed(docs)
        .select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
        .where("weight <> 0")
        .select(
            "doc_id",
            F.col("bucket").cast("bigint").alias("bucket"),
            F.round(F.col("weight").cast("double"), 6).alias("weight"),
        )
    )


def _letter_counts(texts):
    return [[len(t), t.count("e"), t.count(" ")] for t in texts]


def embed_batches(spark, folder):
    """Documents embedded through a user function, fifty texts per call."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    vectors = embed_with(docs, _letter_counts)
    return vectors.select(
        "doc_id",
        *[
            F.get("embedding", F.lit(i)).cast("bigint").alias(name)
            for i, name in enumerate(("chars", "letters_e", "spaces"))
        ],
    )


def chunk_tokens(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_windows(docs).select(
        "doc_id",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("token_count").cast("bigint").alias("token_count"),
        "text",
    )


QUERIES = {
    "jsonl_roundtrip": jsonl_roundtrip,
    "ingest_chunks": ingest_chunks,
    "ingest_append": ingest_append,
    "index_versions": index_versions,
    "scan_chunks": scan_chunks,
    "index_stats": index_stats,
    "dim_check": dim_check,
    "hash_embed": embed_documents,
    "embed_batches": embed_batches,
    "chunk_tokens": chunk_tokens,
}

_META_SQL = f"""
    SELECT chunk_id, source, article_number, coalesce(paragraph_number, 0) AS paragraph_number,
           chunk_type, md5(text) AS text_md5 FROM ({CHUNKS_SQL})"""

ORACLES = {
    "jsonl_roundtrip": f"""
        SELECT article_number, coalesce(paragraph_number, 0) AS paragraph_number, chunk_type, text
        FROM ({CHUNKS_SQL})""",
    "ingest_chunks": f"""
        SELECT chunk_id, source, article_number, coalesce(paragraph_number, 0) AS paragraph_number,
               chunk_type, md5(text) AS text_md5, text FROM ({CHUNKS_SQL})""",
    "ingest_append": _META_SQL,
    "index_versions": f"""
        WITH c AS ({CHUNKS_SQL}),
        v(version, operation, folders) AS (
            VALUES (1, 'bootstrap', 1), (2, 'append', 2), (3, 'append', 3), (4, 'truncate', 0), (5, 'rebuild', 1)),
        held AS (
            SELECT version, chunk_id FROM v, c
            WHERE version IN (2, 3) OR (version = 1 AND chunk_type = 'body')
               OR (version = 5 AND chunk_type = 'elucidation'))
        SELECT version, operation, folders, count(chunk_id) OVER (PARTITION BY version) AS chunks, chunk_id
        FROM v LEFT JOIN held USING (version)""",
    "scan_chunks": _META_SQL,
    "index_stats": f"SELECT chunk_type, count(*) AS chunks FROM ({CHUNKS_SQL}) GROUP BY ALL",
    "dim_check": """
        SELECT label, count(*) AS vectors, count(*) FILTER (vec_id % 7 = 0 OR vec_id % 11 = 0) AS wrong
        FROM embeddings GROUP BY ALL""",
    "hash_embed": f"""
        WITH {sql_embeddings("emb", "documents", "doc_id", "text")}
        SELECT doc_id, bucket, round(weight, 6) AS weight FROM (
            SELECT doc_id, generate_subscripts(embedding, 1) - 1 AS bucket,
                   unnest(embedding) AS weight FROM emb)
        WHERE weight <> 0""",
    "embed_batches": """
        SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, 'e', '')) AS letters_e,
               length(text) - length(replace(text, ' ', '')) AS spaces FROM documents""",
    "chunk_tokens": f"""
        WITH t AS (SELECT doc_id, {sql_words("text")} AS t FROM documents),
        w AS (SELECT doc_id, t, unnest(range(0, 1 + ceil(greatest(len(t) - 300, 0) / 270.0)::BIGINT))
              AS chunk_index FROM t WHERE len(t) > 0)
        SELECT doc_id, chunk_index, len(p) AS token_count, array_to_string(p, ' ') AS text
        FROM (SELECT doc_id, chunk_index,
                     list_slice(t, chunk_index * 270 + 1, chunk_index * 270 + 300) AS p FROM w)""",
}
