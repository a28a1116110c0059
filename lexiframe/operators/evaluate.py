"""Article categories, related articles and retrieval quality."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.operators.validate import explode_range


def categorize(df: DataFrame, article: str, categories=fixed.ARTICLE_CATEGORIES) -> DataFrame:
    """Add the category whose closed article range holds the number (null outside all).

    The ranges are a short literal list, so this is a projection.
    """
    category = F.lit(None).cast("string")
    for name, lo, hi in reversed(categories):
        category = F.when(F.col(article).between(lo, hi), F.lit(name)).otherwise(category)
    return df.withColumn("category", category)


def related_articles(spark, entries=fixed.RELATED_ARTICLES) -> DataFrame:
    """(term, article_number) from lists such as '77-88, 281'."""
    table = spark.createDataFrame(entries, "term string, articles string")
    part = F.explode(F.split("articles", r",\s*")).alias("part")
    bounds = table.select("term", part).select(
        "term",
        F.split_part("part", F.lit("-"), F.lit(1)).cast("bigint").alias("lo"),
        F.split_part("part", F.lit("-"), F.lit(-1)).cast("bigint").alias("hi"),
    )
    return explode_range(bounds, "lo", "hi", "article_number").select("term", "article_number")


def with_related_terms(df: DataFrame, article: str) -> DataFrame:
    """Rows with each term their article is listed under.

    The lists are a few fixed lines, so their ranges are literals and nothing is joined.
    """
    number = F.col(article)
    listed = []
    for term, articles in fixed.RELATED_ARTICLES:
        bounds = [part.strip().split("-") for part in articles.split(",")]
        within = [number.between(int(b[0]), int(b[-1])) for b in bounds]
        listed.append(F.when(reduce(or_, within), F.lit(term)))
    return df.withColumn("term", F.explode(F.array_compact(F.array(*listed))))


def judged_hits(hits: DataFrame, judgements: DataFrame) -> DataFrame:
    """Flag hits that a judgement(query_id, lo, hi, paragraph) covers; null means any paragraph.

    A hit meets the judgements of its question and is compared with their ranges, so no range is
    spread out.  The planner takes generated judgements for smaller than they are, so they are
    joined by key and never sent whole.
    """
    bounds = [F.col(c).cast("bigint").alias(c) for c in ("lo", "hi")]
    wanted = judgements.select("query_id", *bounds, "paragraph").distinct()
    covers = F.col("article_number").between(F.col("lo"), F.col("hi"))
    fits = F.col("paragraph").isNull() | (
        F.col("paragraph") == F.coalesce("paragraph_number", F.lit(0))
    )
    matched = (
        hits.select("query_id", "rank", "article_number", "paragraph_number")
        .join(wanted.hint("merge"), "query_id")
        .where(covers & fits)
        .select("query_id", "rank")
        .distinct()
        .withColumn("relevant", F.lit(1))
    )
    return hits.join(matched, ["query_id", "rank"], "left").fillna(0, ["relevant"])


def recall_precision(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Per query recall@k and precision@k.

    hits(query_id, rank, relevant 0/1), relevant(query_id, n_relevant).
    """
    found = hits.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.sum("relevant").alias("found")
    )
    return relevant.join(found, "query_id", "left").select(
        "query_id",
        F.coalesce(F.col("found") / F.nullif("n_relevant", F.lit(0)), F.lit(0.0)).alias("recall"),
        (F.coalesce("found", F.lit(0)) / F.lit(k)).alias("precision"),
    )


def mean_quality(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.count("*").alias("queries"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
    )


def acceptance_judgements(spark) -> tuple[DataFrame, DataFrame]:
    """The fixed acceptance questions and their expected articles."""
    questions = [(i, q) for i, (q, _) in enumerate(fixed.ACCEPTANCE_QUESTIONS)]
    wanted = [(i, lo, hi, p) for i, (_, r) in enumerate(fixed.ACCEPTANCE_QUESTIONS) for lo, hi, p in r]
    return (
        spark.createDataFrame(questions, "query_id bigint, message string"),
        spark.createDataFrame(wanted, "query_id bigint, lo bigint, hi bigint, paragraph bigint"),
    )


