"""Vector search and rank fusion queries over all embeddings.

Question q searches vector q (legal), q + 1 (original) and q + 2 .. q + 4 (additional);
the last questions simply have fewer lists.
"""

from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.operators.cells import FIXED_POINT, ROUNDS
from lexiframe.operators.conversation import format_context
from lexiframe.operators.fuse import format_results, fuse
from lexiframe.operators.ivf import knn_ivf, train_cells, with_cell
from lexiframe.operators.knn import knn
from lexiframe.plans.answer import search_lists
from lexiframe.session import checkpointed, scratch_path
from lexiframe.sources.bucketed import BucketedChunks
from lexiframe.sources.vector_index import VectorIndex
from registry.common import CHUNKS_SQL, sql_cosine, sql_embeddings, table


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", "label"
    )


def _queries(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _ranked(hits):
    return hits.select(
        "query_id",
        "chunk_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.round("similarity", 6).alias("similarity"),
    )


def knn_cosine(spark, folder):
    return _ranked(knn(_queries(spark, folder), _vectors(spark, folder)))


def knn_filtered(spark, folder):
    return _ranked(
        knn(_queries(spark, folder), _vectors(spark, folder), where=F.col("label") == 3)
    )


def _probed(spark, folder, probes, cells=16):
    chunks = _vectors(spark, folder).select("chunk_id", "embedding")
    centres = train_cells(chunks, cells)
    indexed = checkpointed(with_cell(chunks, centres), "cells")
    return _ranked(knn_ivf(_queries(spark, folder), indexed, centres, probes=probes))


COARSE, FINE, COARSE_PROBES, PROBES = 8, 4, 4, 10


def vector_index(spark, folder, rounds=ROUNDS):
    """All embeddings stored by cell."""
    path = scratch_path(spark, "vectors")
    return VectorIndex.build(spark, path, _vectors(spark, folder), COARSE, FINE, rounds=rounds)


def search_cells(spark, folder, index):
    """Every vector as a query against the cells it probes."""
    return _ranked(index.search(_queries(spark, folder), 10, COARSE_PROBES, PROBES))


def knn_indexed(spark, folder):
    return search_cells(spark, folder, vector_index(spark, folder))


def knn_indexed_filtered(spark, folder):
    """Cells around vectors taken by hash, as its SQL has them, without training."""
    index = vector_index(spark, folder, rounds=0)
    return _ranked(index.search(_queries(spark, folder), 10, COARSE_PROBES, PROBES, where=F.col("label") == 3))


def knn_exhaustive(spark, folder):
    """Probing every cell must give the exact neighbours."""
    return _probed(spark, folder, probes=16)


def searches(spark, folder):
    """Five searches per question, made from every vector once."""
    def role(shift, list_type, prio, number, k):
        return F.struct(
            (F.col("vec_id") - shift).alias("query_id"),
            F.lit(list_type).alias("list_type"),
            F.lit(prio).alias("list_prio"),
            F.lit(number).alias("sub_query"),
            F.lit(k).alias("k"),
        )

    roles = F.array(
        role(0, fixed.LEGAL, 0, 0, fixed.VECTOR_TOP_K),
        role(1, fixed.ORIGINAL, 1, 0, fixed.VECTOR_TOP_K),
        *[role(2 + i, fixed.ADDITIONAL, 2, i, fixed.ADDITIONAL_TOP_K) for i in range(3)],
    )
    return (
        table(spark, folder, "embeddings")
        .select("embedding", F.explode(roles).alias("s"))
        .select("s.*", "embedding")
        .where("query_id >= 0")
    )


def hits(spark, folder):
    return search_lists(searches(spark, folder), _vectors(spark, folder))


def _fused(df):
    return df.select(
        "query_id",
        "chunk_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.round("score", 6).alias("score"),
        F.round("similarity", 6).alias("similarity"),
        "list_type",
    )


def rrf_fused(spark, folder):
    return _fused(fuse(hits(spark, folder), top_k=fixed.MAX_TOP_K))


def rrf_textbook(spark, folder):
    return _fused(fuse(hits(spark, folder), fusion="rrf", top_k=fixed.MAX_TOP_K))


def document_table(spark, folder):
    """Documents as chunks under their own id."""
    even = F.col("doc_id") % 2 == 0
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        "source",
        F.col("doc_id").alias("article_number"),
        F.when(~even, F.lit(1).cast("bigint")).alias("paragraph_number"),
        F.when(even, fixed.BODY).otherwise(fixed.ELUCIDATION).alias("chunk_type"),
        "text",
    )


def results(spark, folder):
    return format_results(fuse(hits(spark, folder)), document_table(spark, folder))


def retrieve_formatted(spark, folder):
    return _formatted(results(spark, folder))


def _formatted(found):
    return found.select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        "source",
        F.coalesce("article_number", F.lit(-1)).alias("article_number"),
        F.coalesce("paragraph_number", F.lit(0)).alias("paragraph_number"),
        "chunk_type",
        "text",
        F.round("score", 6).alias("score"),
    )


def retrieve_bucketed(spark, folder):
    """Texts from a chunk table bucketed by id; no id counts as few, so the rows meet it by bucket."""
    chunks = BucketedChunks.write(spark, scratch_path(spark, "bucketed"), document_table(spark, folder), 8)
    found = format_results(fuse(hits(spark, folder)), chunks.read(), few=0)
    return _formatted(found)


def context_blocks(spark, folder):
    return format_context(results(spark, folder))


SEARCHES = {"knn_ivf_search": (vector_index, search_cells)}

QUERIES = {
    "knn_cosine": knn_cosine,
    "knn_filtered": knn_filtered,
    "knn_ivf": knn_indexed,
    "knn_ivf_filtered": knn_indexed_filtered,
    "knn_ivf_exhaustive": knn_exhaustive,
    "rrf_fused": rrf_fused,
    "rrf_textbook": rrf_textbook,
    "retrieve_formatted": retrieve_formatted,
    "retrieve_bucketed": retrieve_bucketed,
    "format_context": context_blocks,
}

KNN_SQL = f"""
sims AS (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label,
           {sql_cosine("q.embedding::DOUBLE[]", "c.embedding::DOUBLE[]")} AS sim
    FROM embeddings q, embeddings c),
near AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank
    FROM sims QUALIFY rank <= 10)
"""

HITS_SQL = f"""
{KNN_SQL},
roles(shift, list_type, list_prio, sub_query, k) AS (
    VALUES (0, 'legal_query', 0, 0, 10), (1, 'original_query', 1, 0, 10),
           (2, 'additional', 2, 0, 5), (3, 'additional', 2, 1, 5), (4, 'additional', 2, 2, 5)),
hits AS (
    SELECT n.query_id - shift AS query_id, list_type, list_prio, sub_query, rank, chunk_id, sim
    FROM near n, roles WHERE n.query_id >= shift AND rank <= k)
"""

WEIGHT_SQL = """CASE list_type WHEN 'legal_query' THEN 2.0::DOUBLE WHEN 'original_query' THEN 1.0
                WHEN 'additional' THEN 0.8 ELSE 0.5 END"""

FUSED_SQL = f"""
{HITS_SQL},
firsts AS (
    SELECT * FROM hits QUALIFY row_number() OVER (
        PARTITION BY query_id, chunk_id ORDER BY list_prio, sub_query, rank) = 1),
ranked AS (
    SELECT *, row_number() OVER (
        PARTITION BY query_id, list_prio ORDER BY sub_query, rank, chunk_id) AS lr FROM firsts),
scored AS (
    SELECT *, {WEIGHT_SQL} / (60 + lr) AS part FROM ranked),
normed AS (
    SELECT *, part / max(part) OVER (PARTITION BY query_id) AS score FROM scored),
fused AS (
    SELECT query_id, chunk_id, score, sim, list_type,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_prio, lr, chunk_id) AS rank
    FROM normed WHERE score >= 0.1)
"""

# From ``subs`` (all searches as text) to ``placed`` (fused rank and score per chunk).
def answer_sql(kept="true"):
    """``kept`` is a condition on a hit of a search."""
    return f"""
chunks AS ({CHUNKS_SQL}),
search AS (SELECT *, query_id || '/' || list_prio || '/' || sub_query AS sid FROM subs),
{sql_embeddings("qe", "search", "sid", "search_text")},
{sql_embeddings("de", "chunks", "chunk_id", "text")},
sims AS (SELECT sid, chunk_id, {sql_cosine("qe.embedding", "de.embedding")} AS sim FROM qe, de),
near AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY sim DESC, chunk_id) AS rank
         FROM sims QUALIFY rank <= 10),
hits AS (SELECT * FROM near JOIN search USING (sid) WHERE rank <= k AND {kept}),
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (
           PARTITION BY query_id, chunk_id ORDER BY list_prio, sub_query, rank) = 1),
ranked AS (SELECT *, row_number() OVER (
           PARTITION BY query_id, list_prio ORDER BY sub_query, rank, chunk_id) AS lr FROM firsts),
scored AS (SELECT *, {WEIGHT_SQL} / (60 + lr) AS part FROM ranked),
placed AS (SELECT query_id, chunk_id, part / max(part) OVER (PARTITION BY query_id) AS score,
                  row_number() OVER (
                      PARTITION BY query_id ORDER BY part DESC, list_prio, lr, chunk_id) AS place
           FROM scored)
"""

ANSWER_SQL = answer_sql()

FORMATTED_SQL = f"""
{FUSED_SQL},
formatted AS (
    SELECT query_id, rank, coalesce(source, '') AS source,
           coalesce(doc_id, -1) AS article_number,
           CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END AS paragraph_number,
           CASE WHEN doc_id % 2 = 1 THEN 'elucidation' ELSE 'body' END AS chunk_type,
           coalesce(text, '') AS text, round(score, 6) AS score
    FROM fused LEFT JOIN documents ON chunk_id = doc_id WHERE rank <= 5)
"""

CONTEXT_SQL = """
    '[' || rank || '] Pasal ' || CASE WHEN article_number < 0 THEN '?' ELSE article_number::VARCHAR END
    || CASE WHEN paragraph_number > 0 THEN ' ayat (' || paragraph_number || ')' ELSE '' END
    || ' (' || CASE chunk_type WHEN 'elucidation' THEN 'Penjelasan' ELSE 'Isi' END || '):' || chr(10)
    || text
"""

_NEAR_SQL = f"""
    WITH {KNN_SQL} SELECT query_id, chunk_id, rank, round(sim, 6) AS similarity FROM near"""



def ivf_sql(where="true", rounds=0):
    """Cells by nearest centre, probes by nearest cell, exact scores within.

    Centres are vectors by hash, moved by ``rounds`` of k-means.
    """
    near = sql_cosine("a.v", "b.v")
    return f"""
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, md5(vec_id::VARCHAR) AS h FROM embeddings),
    usable AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
    {_coarse_sql(rounds)}
    csims AS (SELECT a.vec_id, c, {near} AS sim FROM e a, coarse b),
    cranks AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, c) AS r FROM csims),
    firsts AS (
        SELECT c, row_number() OVER (PARTITION BY c ORDER BY h, vec_id, v) AS n, v
        FROM usable JOIN cranks USING (vec_id) WHERE r = 1 QUALIFY n <= {FINE}
        UNION ALL SELECT c, 1, v FROM coarse
        WHERE c NOT IN (SELECT c FROM usable JOIN cranks USING (vec_id) WHERE r = 1)),
    {_fine_sql(rounds)}
    fsims AS (
        SELECT a.vec_id, r, f, {near} AS sim
        FROM e a JOIN cranks USING (vec_id) JOIN fine b USING (c) WHERE r <= {COARSE_PROBES}),
    owned AS (
        SELECT vec_id, f FROM fsims WHERE r = 1
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, f) = 1),
    probed AS (
        SELECT vec_id, f FROM fsims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, f) <= {PROBES}),
    met AS (
        SELECT p.vec_id AS query_id, o.vec_id AS chunk_id, {near} AS sim
        FROM probed p JOIN owned o USING (f) JOIN e a ON a.vec_id = p.vec_id JOIN e b ON b.vec_id = o.vec_id
        WHERE b.{where})
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank,
           round(sim, 6) AS similarity
    FROM met QUALIFY rank <= 10"""


def _coarse_sql(rounds):
    first = f"SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS c, v FROM usable QUALIFY c < {COARSE}"
    if not rounds:
        return f"coarse AS ({first}),"
    parts = f"list_transform(v, lambda x: floor(x / length * {FIXED_POINT} + 0.5)::BIGINT)"
    return f"""units AS MATERIALIZED (
        SELECT vec_id, v, {parts} AS parts
        FROM (SELECT *, sqrt(list_dot_product(v, v)) AS length FROM usable)),
    {_kmeans_sql("coarse", "c", first, "units a, {centres} b", rounds)}"""


def _fine_sql(rounds):
    first = "SELECT row_number() OVER (ORDER BY c, n) - 1 AS f, c, v FROM firsts"
    if not rounds:
        return f"fine AS ({first}),"
    own = "(SELECT u.*, c FROM units u JOIN cranks USING (vec_id) WHERE r = 1) a JOIN {centres} b USING (c)"
    return _kmeans_sql("fine", "f", first, own, rounds)


def _kmeans_sql(name, number, first, pairs, rounds):
    """CTE ``name``: the centres of ``first`` after ``rounds``; ``pairs`` are vectors a and centres b they may go to."""
    near = sql_cosine("a.v", "b.v")
    steps = [f"{name}_0 AS MATERIALIZED ({first}),"]
    for i in range(rounds):
        centres = f"{name}_{i}"
        last = i == rounds - 1
        steps.append(f"""
    {centres}_own AS MATERIALIZED (
        SELECT a.parts, b.{number} FROM {pairs.format(centres=centres)}
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {near} DESC, b.{number}) = 1),
    {centres}_sums AS MATERIALIZED (
        SELECT {number}, list(s::DOUBLE ORDER BY d) AS sums FROM (
            SELECT {number}, d, sum(part) AS s
            FROM (SELECT {number}, unnest(parts) AS part, generate_subscripts(parts, 1) AS d FROM {centres}_own)
            GROUP BY ALL)
        GROUP BY {number} HAVING bool_or(s <> 0)),
    {name if last else f"{name}_{i + 1}"} AS MATERIALIZED (
        SELECT b.* REPLACE (coalesce(sums, v) AS v) FROM {centres} b LEFT JOIN {centres}_sums USING ({number})),""")
    return "".join(steps)


ORACLES = {
    "knn_ivf": ivf_sql("vec_id IS NOT NULL", ROUNDS),
    "knn_ivf_filtered": ivf_sql("label = 3"),
    "knn_cosine": _NEAR_SQL,
    "knn_ivf_exhaustive": _NEAR_SQL,
    "knn_filtered": f"""
        WITH {KNN_SQL}
        SELECT query_id, chunk_id, row_number() OVER (
                   PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank,
               round(sim, 6) AS similarity
        FROM sims WHERE label = 3 QUALIFY rank <= 10""",
    "rrf_fused": f"""
        WITH {FUSED_SQL}
        SELECT query_id, chunk_id, rank, round(score, 6) AS score, round(sim, 6) AS similarity,
               list_type FROM fused WHERE rank <= 20""",
    "rrf_textbook": f"""
        WITH {HITS_SQL},
        ranked AS (
            SELECT *, row_number() OVER (
                PARTITION BY query_id, list_prio ORDER BY sub_query, rank, chunk_id) AS lr FROM hits),
        summed AS (
            SELECT query_id, chunk_id, round(sum({WEIGHT_SQL} / (60 + lr)), 15) AS part,
                   max(sim) AS sim, arg_min(list_type, list_prio * 1000 + lr) AS list_type,
                   min(list_prio) AS list_prio, arg_min(lr, list_prio * 1000 + lr) AS lr
            FROM ranked GROUP BY ALL),
        normed AS (SELECT *, part / max(part) OVER (PARTITION BY query_id) AS score FROM summed)
        SELECT query_id, chunk_id, row_number() OVER (
                   PARTITION BY query_id ORDER BY score DESC, list_prio, lr, chunk_id) AS rank,
               round(score, 6) AS score, round(sim, 6) AS similarity, list_type
        FROM normed WHERE score >= 0.1 QUALIFY rank <= 20""",
    "retrieve_formatted": f"WITH {FORMATTED_SQL} SELECT * FROM formatted",
    "retrieve_bucketed": f"WITH {FORMATTED_SQL} SELECT * FROM formatted",
    "format_context": f"""
        WITH {FORMATTED_SQL}
        SELECT query_id, string_agg({CONTEXT_SQL}, chr(10) || chr(10) ORDER BY rank) AS context,
               count(*) AS passages
        FROM formatted GROUP BY ALL""",
}
