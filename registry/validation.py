"""Integrity queries: line items as segments, one document per return flag.

Article = order key + 1, paragraph = line number, expected articles = number of orders.
"""

from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.operators import validate
from lexiframe.plans.statutes import publish_segments
from lexiframe.session import scratch_path
from lexiframe.sources.jsonl import DOCUMENT_SCHEMA, read_jsonl
from registry.common import table


def _segments(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("doc_id"),
        F.lit(fixed.BODY).alias("section"),
        (F.col("l_orderkey") + 1).alias("article_number"),
        F.col("l_linenumber").alias("paragraph_number"),
    )


def _expected(spark, folder):
    docs = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("doc_id")).distinct()
    total = table(spark, folder, "orders").count()
    return docs.select(
        "doc_id",
        F.lit(fixed.BODY).alias("section"),
        F.lit(total).cast("bigint").alias("expected_articles"),
    )


def missing_articles(spark, folder):
    return validate.missing_articles(_segments(spark, folder), _expected(spark, folder))


def missing_paragraphs(spark, folder):
    return validate.missing_paragraphs(_segments(spark, folder))


def duplicate_keys(spark, folder):
    return validate.duplicate_keys(_segments(spark, folder)).select(
        "doc_id",
        "section",
        "article_number",
        F.col("paragraph_number").cast("bigint").alias("paragraph_number"),
        "occurrences",
    )


def validation_report(spark, folder):
    return validate.validation_report(_segments(spark, folder), _expected(spark, folder))


def publish_valid(spark, folder):
    """Orders as documents, line items as articles, read back from the published JSON lines.

    Some orders lack an article, some have one twice: these stay out.
    """
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(fixed.BODY).alias("section"),
        F.col("l_linenumber").cast("bigint").alias("article_number"),
        F.lit(1).cast("bigint").alias("paragraph_number"),
        F.concat_ws("/", "l_partkey", "l_suppkey").alias("text"),
    )
    expected = items.groupBy("doc_id", "section").agg(F.max("article_number").alias("expected_articles"))
    kept = items.where((F.col("doc_id") % 5 != 0) | (F.col("article_number") != 2))
    twice = items.where((F.col("doc_id") % 7 == 0) & (F.col("article_number") == 1))
    path = scratch_path(spark, "published")
    publish_segments(kept.unionByName(twice), expected, path)
    rows = read_jsonl(spark, path, f"{DOCUMENT_SCHEMA}, section string")
    return rows.select("doc_id", "section", "article_number", "paragraph_number", "text")


_SQL = """
seg AS (SELECT l_returnflag AS doc_id, 'body' AS section, l_orderkey + 1 AS article_number,
               l_linenumber::BIGINT AS paragraph_number FROM lineitem),
docs AS (SELECT DISTINCT doc_id, section FROM seg),
want AS (SELECT doc_id, section, unnest(range(1, (SELECT count(*) FROM orders) + 1)) AS article_number
         FROM docs),
no_article AS (SELECT * FROM want ANTI JOIN seg USING (doc_id, section, article_number)),
tops AS (SELECT doc_id, section, article_number, max(paragraph_number) AS top FROM seg GROUP BY ALL),
no_paragraph AS (
    SELECT * FROM (SELECT doc_id, section, article_number, unnest(range(1, top + 1)) AS paragraph_number
                   FROM tops)
    ANTI JOIN seg USING (doc_id, section, article_number, paragraph_number)),
twice AS (SELECT doc_id, section, article_number, paragraph_number, count(*) AS occurrences
          FROM seg GROUP BY ALL HAVING count(*) > 1)
"""

QUERIES = {
    "missing_articles": missing_articles,
    "missing_paragraphs": missing_paragraphs,
    "duplicate_keys": duplicate_keys,
    "validation_report": validation_report,
    "publish_valid": publish_valid,
}

ORACLES = {
    "publish_valid": """
        WITH items AS (
            SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS article_number, l_partkey || '/' || l_suppkey AS text,
                   max(l_linenumber) OVER (PARTITION BY l_orderkey) AS top FROM lineitem)
        SELECT doc_id, 'body' AS section, article_number, 1::BIGINT AS paragraph_number, text FROM items
        WHERE doc_id % 7 <> 0 AND (doc_id % 5 <> 0 OR top < 2)
          AND doc_id NOT IN (SELECT doc_id FROM items GROUP BY doc_id HAVING count(*) <> max(top)
                             OR count(DISTINCT article_number) <> max(top))""",
    "missing_articles": f"WITH {_SQL} SELECT * FROM no_article",
    "missing_paragraphs": f"WITH {_SQL} SELECT * FROM no_paragraph",
    "duplicate_keys": f"WITH {_SQL} SELECT * FROM twice",
    "validation_report": f"""
        WITH {_SQL}
        SELECT *, total_articles = expected_articles AND missing_articles = 0
                  AND missing_paragraphs = 0 AND duplicate_keys = 0 AS is_valid
        FROM (
        SELECT d.doc_id, d.section, (SELECT count(*) FROM orders) AS expected_articles,
               (SELECT count(DISTINCT article_number) FROM seg s WHERE s.doc_id = d.doc_id)
                   AS total_articles,
               (SELECT count(*) FROM no_article s WHERE s.doc_id = d.doc_id) AS missing_articles,
               (SELECT count(*) FROM no_paragraph s WHERE s.doc_id = d.doc_id) AS missing_paragraphs,
               (SELECT count(*) FROM twice s WHERE s.doc_id = d.doc_id) AS duplicate_keys,
               'checked' AS status
        FROM docs d)""",
}
