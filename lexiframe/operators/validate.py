"""Integrity checks of segmented documents.

Findings stay in long form (one row per missing or duplicate key), so a document with
any number of defects never has to fit one row; the report keeps counts and validity.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOC = ["doc_id", "section"]
_STEP = 4096


def explode_range(df: DataFrame, lo, hi, name: str) -> DataFrame:
    """One row per integer in lo..hi, generated in steps so no array holds a whole range."""
    lo, hi = F.expr(lo).cast("bigint"), F.expr(hi).cast("bigint")
    start = F.col("_start")
    return (
        df.where(hi >= lo)
        .withColumn("_start", F.explode(F.sequence(lo, hi, F.lit(_STEP).cast("bigint"))))
        .withColumn(name, F.explode(F.sequence(start, F.least(start + (_STEP - 1), hi))))
        .drop("_start")
    )


def missing_articles(segments: DataFrame, expected: DataFrame) -> DataFrame:
    """Numbers of 1..N without a segment; expected(doc_id, section, expected_articles)."""
    wanted = explode_range(expected, "1", "expected_articles", "article_number").select(
        *DOC, "article_number"
    )
    return wanted.join(
        segments.select(*DOC, F.col("article_number").cast("bigint").alias("article_number")),
        [*DOC, "article_number"],
        "left_anti",
    )


def missing_paragraphs(segments: DataFrame) -> DataFrame:
    """Paragraph numbers below an article's highest one that do not occur.

    Distinct numbers are compared with their predecessor and only gaps are expanded.
    """
    present = (
        segments.where(F.coalesce("paragraph_number", F.lit(0)) != 0)
        .select(*DOC, "article_number", F.col("paragraph_number").cast("bigint").alias("p"))
        .distinct()
    )
    before = Window.partitionBy(*DOC, "article_number").orderBy("p")
    gaps = present.withColumn("_from", F.coalesce(F.lag("p").over(before), F.lit(0)) + 1)
    return explode_range(gaps, "_from", "p - 1", "paragraph_number").select(
        *DOC, "article_number", "paragraph_number"
    )


def duplicate_keys(segments: DataFrame) -> DataFrame:
    """(article, paragraph) pairs occurring more than once; no paragraph counts as 0."""
    paragraph = F.coalesce("paragraph_number", F.lit(0)).alias("paragraph_number")
    return (
        segments.select(*DOC, "article_number", paragraph)
        .groupBy(*DOC, "article_number", "paragraph_number")
        .agg(F.count("*").alias("occurrences"))
        .where("occurrences > 1")
    )


def validation_report(segments: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per expected document: counts of each finding, status and validity.

    Counts follow from three nested aggregations (key, article, document); nothing missing
    has to be generated.  ``status`` is 'no_paragraphs' where no numbered paragraph exists
    at all, which is an error of its own.
    """
    paragraph = F.coalesce("paragraph_number", F.lit(0)).cast("bigint").alias("p")
    keys = (
        segments.select(*DOC, "article_number", paragraph)
        .groupBy(*DOC, "article_number", "p")
        .agg(F.count("*").alias("n"))
    )
    articles = keys.groupBy(*DOC, "article_number").agg(
        F.sum((F.col("n") > 1).cast("bigint")).alias("duplicate_keys"),
        (
            F.greatest(F.max("p"), F.lit(0)) - F.sum((F.col("p") > 0).cast("bigint"))
        ).alias("missing_paragraphs"),
        F.max(F.col("p") != 0).alias("has_paragraphs"),
    )
    within = F.col("article_number").between(1, F.col("expected_articles"))
    found = (
        articles.join(expected, DOC)
        .groupBy(*DOC)
        .agg(
            F.count("article_number").alias("total_articles"),
            F.sum(within.cast("bigint")).alias("_within"),
            F.sum("missing_paragraphs").alias("missing_paragraphs"),
            F.sum("duplicate_keys").alias("duplicate_keys"),
            F.max("has_paragraphs").alias("has_paragraphs"),
        )
    )
    counts = ["total_articles", "_within", "missing_paragraphs", "duplicate_keys"]
    report = (
        expected.join(found, DOC, "left")
        .fillna(0, counts)
        .fillna(False, ["has_paragraphs"])
        .withColumn("missing_articles", F.col("expected_articles") - F.col("_within"))
    )
    clean = (
        F.col("has_paragraphs")
        & (F.col("total_articles") == F.col("expected_articles"))
        & (F.col("missing_articles") == 0)
        & (F.col("missing_paragraphs") == 0)
        & (F.col("duplicate_keys") == 0)
    )
    return report.select(
        *DOC,
        "expected_articles",
        "total_articles",
        "missing_articles",
        "missing_paragraphs",
        "duplicate_keys",
        F.when(F.col("has_paragraphs"), "checked").otherwise("no_paragraphs").alias("status"),
        clean.alias("is_valid"),
    )


def only_valid(segments: DataFrame, report: DataFrame) -> DataFrame:
    """Segments of documents all of whose sections were checked and found valid.

    A document with a section that the report lacks, or whose validity is unknown, stays out.
    """
    valid = report.where("is_valid").select(*DOC).distinct()
    unchecked = segments.select(*DOC).distinct().join(valid, DOC, "left_anti").select("doc_id")
    failed = report.where(~F.coalesce("is_valid", F.lit(False))).select("doc_id")
    return segments.where(F.col("doc_id").isNotNull()).join(
        unchecked.union(failed).distinct(), "doc_id", "left_anti"
    )
