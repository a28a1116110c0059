"""Keyword ranking, substring search and hybrid fusion: benchmark passages as questions."""

from pyspark.sql import functions as F

from lexiframe.functions.text import non_blank_lines
from lexiframe.operators import keyword as ops
from lexiframe.operators.chunks import hash_embed
from lexiframe.operators.fuse import fuse
from lexiframe.plans.answer import search_lists
from lexiframe.session import scratch_path
from lexiframe.sources.index import bootstrap_index, read_index
from lexiframe.sources.postings import PostingsIndex
from registry.common import sql_cosine, sql_embeddings, sql_lines, table

HYBRID_WEIGHTS = {"original_query": 1.0, "keyword": 1.0}


def questions(spark, folder):
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("search_text")
    )


def line_questions(spark, folder):
    """Every line of every passage as a question of its own."""
    lines = table(spark, folder, "benchmark").select(
        "item_id", F.posexplode(non_blank_lines(F.col("text"))).alias("i", "search_text")
    )
    return lines.select(F.concat_ws("-", "item_id", "i").alias("query_id"), "search_text")


def documents(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def indexed_documents(spark, folder):
    """Documents embedded once, written, read back."""
    path = scratch_path(spark, "documents")
    bootstrap_index(hash_embed(documents(spark, folder)), path)
    return read_index(spark, path)


def postings_index(spark, folder):
    """Postings of all documents, written by term."""
    return PostingsIndex.build(spark, scratch_path(spark, "postings"), documents(spark, folder))


def _scored(hits):
    return hits.select(
        "query_id",
        "chunk_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.round("score", 6).alias("score"),
    )


def search_postings(spark, folder, index):
    """Every passage against the postings of all documents."""
    return _scored(index.search(questions(spark, folder)))


def bm25(spark, folder):
    return search_postings(spark, folder, postings_index(spark, folder))


def bm25_scan(spark, folder):
    """The same without an index."""
    return _scored(ops.bm25(questions(spark, folder), documents(spark, folder)))


def keyword_contains(spark, folder):
    found = ops.search_by_text(
        hash_embed(line_questions(spark, folder), text="search_text"),
        indexed_documents(spark, folder),
    )
    return found.select(
        "query_id",
        "chunk_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.round("similarity", 6).alias("similarity"),
    )


def hybrid_rrf(spark, folder):
    """One vector list and one keyword list per question, fused without de-duplication."""
    asked, docs = questions(spark, folder), documents(spark, folder)
    searches = hash_embed(asked, text="search_text").select(
        "query_id",
        F.lit("original_query").alias("list_type"),
        F.lit(1).alias("list_prio"),
        F.lit(0).alias("sub_query"),
        F.lit(10).alias("k"),
        "embedding",
    )
    hits = ops.hybrid_hits(search_lists(searches, hash_embed(docs)), postings_index(spark, folder).search(asked))
    return _scored(fuse(hits, fusion="rrf", top_k=20, weights=HYBRID_WEIGHTS))


SEARCHES = {"bm25_search": (postings_index, search_postings)}

QUERIES = {"bm25": bm25, "bm25_scan": bm25_scan, "keyword_contains": keyword_contains, "hybrid_rrf": hybrid_rrf}

_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"

_BM25_SQL = f"""
tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tok),
qterm AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
tf AS (SELECT doc_id, term, dl, count(*) AS tf
       FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok)
       WHERE term IN (SELECT term FROM qterm) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
bm_scores AS (
    SELECT query_id, doc_id AS chunk_id,
           round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1)
                     / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
    FROM qterm JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
       FROM bm_scores QUALIFY rank <= 10)
"""

ORACLES = {
    "bm25": f"""
        WITH {_BM25_SQL} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm""",
    "bm25_scan": f"""
        WITH {_BM25_SQL} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm""",
    "keyword_contains": f"""
        WITH lq AS (
            SELECT item_id || '-' || (generate_subscripts(l, 1) - 1) AS query_id, unnest(l) AS text
            FROM (SELECT item_id, {sql_lines("text")} AS l FROM benchmark)),
        {sql_embeddings("qe", "lq", "query_id", "text")},
        {sql_embeddings("de", "documents", "doc_id", "text")},
        pairs AS (SELECT query_id, doc_id FROM lq, documents d WHERE contains(d.text, lq.text)),
        sims AS (SELECT query_id, doc_id AS chunk_id,
                        {sql_cosine("qe.embedding", "de.embedding")} AS sim
                 FROM pairs JOIN qe USING (query_id) JOIN de USING (doc_id))
        SELECT query_id, chunk_id, row_number() OVER (
                   PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank,
               round(sim, 6) AS similarity FROM sims QUALIFY rank <= 10""",
    "hybrid_rrf": f"""
        WITH {_BM25_SQL},
        {sql_embeddings("qe", "benchmark", "item_id", "text")},
        {sql_embeddings("de", "documents", "doc_id", "text")},
        sims AS (SELECT item_id AS query_id, doc_id AS chunk_id,
                        {sql_cosine("qe.embedding", "de.embedding")} AS sim FROM qe, de),
        near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank
                 FROM sims QUALIFY rank <= 10),
        hits AS (SELECT query_id, chunk_id, rank, 1 AS prio FROM near
                 UNION ALL SELECT query_id, chunk_id, rank, 3 FROM bm),
        summed AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 15) AS part,
                          min(prio) AS prio, arg_min(rank, prio) AS lr FROM hits GROUP BY ALL),
        normed AS (SELECT *, part / max(part) OVER (PARTITION BY query_id) AS score FROM summed)
        SELECT query_id, chunk_id, row_number() OVER (
                   PARTITION BY query_id ORDER BY score DESC, prio, lr, chunk_id) AS rank,
               round(score, 6) AS score
        FROM normed WHERE score >= 0.1 QUALIFY rank <= 20""",
}
