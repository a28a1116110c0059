"""Categories, related articles and retrieval quality."""

from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.operators import evaluate as ops
from lexiframe.operators.fuse import fuse
from registry.common import quoted, table
from registry.retrieval import FORMATTED_SQL, FUSED_SQL, hits, results


def category_range_join(spark, folder):
    """Line items per article category; article = order key + 1."""
    items = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("article_number"), "l_linenumber"
    )
    return (
        ops.categorize(items, "article_number")
        .groupBy(F.coalesce("category", F.lit("(none)")).alias("category"))
        .agg(
            F.count("*").alias("items"), F.countDistinct("article_number").alias("articles")
        )
    )


def related_articles(spark, folder):
    """Line items per dictionary term through the articles listed under it."""
    items = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("article_number")
    )
    return (
        ops.with_related_terms(items, "article_number")
        .groupBy("term", "article_number")
        .agg(F.count("*").alias("items"))
    )


def _quality(spark, folder):
    """Recall@5 and precision@5 per question; relevant = same label as the legal vector."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    best = fuse(hits(spark, folder)).select("query_id", "rank", "chunk_id")
    judged = (
        best.join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
        .join(labels.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("found")), "chunk_id")
        .select("query_id", "rank", (F.col("label") == F.col("found")).cast("int").alias("relevant"))
    )
    sizes = labels.groupBy("label").agg(F.count("*").alias("n_relevant"))
    relevant = labels.join(sizes, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")
    return ops.recall_precision(judged, relevant)


def eval_recall_precision(spark, folder):
    return _quality(spark, folder).select(
        "query_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision")
    )


def eval_mean_quality(spark, folder):
    return ops.mean_quality(_quality(spark, folder)).select(
        "queries", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision")
    )


def eval_judgements(spark, folder):
    """Results judged by article ranges: fifty articles either side of the question's own."""
    q = F.col("vec_id")
    judgements = table(spark, folder, "embeddings").select(
        q.alias("query_id"),
        F.greatest(q - 50, F.lit(0)).alias("lo"),
        (q + 50).alias("hi"),
        F.when(q % 2 == 1, F.lit(1).cast("bigint")).alias("paragraph"),
    )
    return ops.judged_hits(results(spark, folder), judgements).select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.col("relevant").cast("bigint").alias("relevant"),
    )


QUERIES = {
    "eval_judgements": eval_judgements,
    "category_range_join": category_range_join,
    "related_articles": related_articles,
    "eval_recall_precision": eval_recall_precision,
    "eval_mean_quality": eval_mean_quality,
}

_CATEGORIES = ", ".join(f"({quoted(n)}, {lo}, {hi})" for n, lo, hi in fixed.ARTICLE_CATEGORIES)
_RELATED = ", ".join(
    f"({quoted(t)}, {int(p.split('-')[0])}, {int(p.split('-')[-1])})"
    for t, articles in fixed.RELATED_ARTICLES
    for p in articles.split(", ")
)

_QUALITY_SQL = f"""
{FUSED_SQL},
judged AS (
    SELECT f.query_id, count(*) FILTER (q.label = c.label) AS found
    FROM fused f JOIN embeddings q ON q.vec_id = f.query_id JOIN embeddings c ON c.vec_id = f.chunk_id
    WHERE rank <= 5 GROUP BY ALL),
sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL),
quality AS (
    SELECT vec_id AS query_id, coalesce(found, 0) / n::DOUBLE AS recall,
           coalesce(found, 0) / 5.0::DOUBLE AS precision
    FROM embeddings JOIN sizes USING (label) LEFT JOIN judged ON query_id = vec_id)
"""

ORACLES = {
    "eval_judgements": f"""
        WITH {FORMATTED_SQL}
        SELECT query_id, rank, CASE WHEN article_number BETWEEN greatest(query_id - 50, 0) AND query_id + 50
               AND (query_id % 2 = 0 OR paragraph_number = 1) THEN 1 ELSE 0 END AS relevant
        FROM formatted""",
    "category_range_join": f"""
        SELECT coalesce(category, '(none)') AS category, count(*) AS items,
               count(DISTINCT l_orderkey) AS articles
        FROM lineitem LEFT JOIN (VALUES {_CATEGORIES}) c(category, lo, hi)
             ON l_orderkey + 1 BETWEEN lo AND hi GROUP BY ALL""",
    "related_articles": f"""
        SELECT term, l_orderkey + 1 AS article_number, count(*) AS items
        FROM lineitem JOIN (VALUES {_RELATED}) r(term, lo, hi) ON l_orderkey + 1 BETWEEN lo AND hi
        GROUP BY ALL""",
    "eval_recall_precision": f"""
        WITH {_QUALITY_SQL}
        SELECT query_id, round(recall, 6) AS recall, round(precision, 6) AS precision FROM quality""",
    "eval_mean_quality": f"""
        WITH {_QUALITY_SQL}
        SELECT count(*) AS queries, round(avg(recall), 6) AS recall,
               round(avg(precision), 6) AS precision FROM quality""",
}
