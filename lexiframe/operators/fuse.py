"""Rank fusion of several result lists per question, and result projection."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.session import checkpointed

FEW_IDS = 1 << 17  # distinct ids that are sent to every task
POPULAR = 1 << 14  # rows that share one id before its text is sent to them
POPULAR_BYTES = 64 << 20


def _weight(weights) -> Column:
    w = F.lit(float(fixed.UNKNOWN_LIST_WEIGHT))
    for name, value in reversed(list(weights.items())):
        w = F.when(F.col("list_type") == name, F.lit(float(value))).otherwise(w)
    return w


def first_hits(hits: DataFrame) -> DataFrame:
    """Keep a chunk only in the first list that returned it (list, sub-query, rank order)."""
    order = Window.partitionBy("query_id", "chunk_id").orderBy("list_prio", "sub_query", "rank")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def list_ranks(hits: DataFrame) -> DataFrame:
    """Rank inside a list type; all additional sub-queries of a question share one list."""
    order = Window.partitionBy("query_id", "list_prio").orderBy("sub_query", "rank", "chunk_id")
    return hits.withColumn("list_rank", F.row_number().over(order))


def fuse(
    hits: DataFrame,
    fusion: str = "first_hit",
    top_k: Column | int | None = fixed.FINAL_TOP_K,
    weights=None,
    rrf_k: int = fixed.RRF_K,
    threshold: float = fixed.SCORE_THRESHOLD,
    min_cosine: float | None = None,
) -> DataFrame:
    """Weighted reciprocal rank fusion, normalised by the best score of each question.

    hits(query_id, list_type, list_prio, sub_query, rank, chunk_id, similarity) ->
    (query_id, chunk_id, score, rank, similarity, list_type).  ``first_hit`` gives a chunk
    only the score of its first list; ``rrf`` sums the scores over all lists.
    """
    if min_cosine is not None:
        hits = hits.where(F.col("similarity") >= min_cosine)
    # a question has a few dozen hits; one shuffle serves every window below
    hits = hits.repartition("query_id")
    weight = _weight(weights or fixed.LIST_WEIGHTS)
    if fusion == "first_hit":
        hits = first_hits(hits)
    elif fusion != "rrf":
        raise ValueError(f"unknown fusion {fusion!r}")
    scored = list_ranks(hits).withColumn("_part", weight / (F.lit(rrf_k) + F.col("list_rank")))
    if fusion == "rrf":
        first = F.struct("list_prio", "list_rank")
        scored = scored.groupBy("query_id", "chunk_id").agg(
            F.round(F.sum("_part"), 15).alias("_part"),
            F.max("similarity").alias("similarity"),
            F.min_by("list_type", first).alias("list_type"),
            F.min("list_prio").alias("list_prio"),
            F.min_by("list_rank", first).alias("list_rank"),
        )
    per_query = Window.partitionBy("query_id")
    scored = scored.withColumn("score", F.col("_part") / F.max("_part").over(per_query)).where(
        F.col("score") >= threshold
    )
    best_first = per_query.orderBy(F.desc("score"), "list_prio", "list_rank", "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(best_first))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.select("query_id", "chunk_id", "score", "rank", "similarity", "list_type")


def default_if_unset(col: Column, default) -> Column:
    """Default for a request parameter; null and zero both count as unset."""
    return F.coalesce(F.nullif(col, F.lit(0)), F.lit(default))


def hydrate(fused: DataFrame, meta: DataFrame, few: int = FEW_IDS, popular: int = POPULAR) -> DataFrame:
    """Written ``fused`` rows with the columns of ``meta`` for their chunk id, null where unknown.

    A few distinct ids (counted) are sent to the chunk table, which is read where it lies.  More meet
    it by id; a table bucketed by id (``BucketedChunks``) is not shuffled for that.  Ids that very many
    rows share would meet in one task either way, so their texts, few by nature and counted in
    bytes, are sent to the rows instead.
    """
    ids = checkpointed(fused.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows")), "ids")
    if ids.limit(few + 1).count() <= few:
        meta = meta.join(F.broadcast(ids.select("chunk_id")), "chunk_id", "left_semi")
    hot = ids.where(F.col("rows") > popular).select("chunk_id")
    if hot.isEmpty() or hot.limit(few + 1).count() > few:
        return fused.join(meta, "chunk_id", "left")
    texts = checkpointed(meta.join(F.broadcast(hot), "chunk_id", "left_semi"), "popular")
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes")).first().bytes or 0
    sent = F.broadcast(texts) if size <= POPULAR_BYTES else texts
    shared = fused.join(F.broadcast(hot), "chunk_id", "left_semi").join(sent, "chunk_id", "left")
    rest = fused.join(F.broadcast(hot), "chunk_id", "left_anti").join(meta, "chunk_id", "left")
    return rest.unionByName(shared)


def format_results(fused: DataFrame, chunks: DataFrame, **limits) -> DataFrame:
    """Late join of the few surviving chunk ids to their text and metadata, with defaults.

    The fused rows are written first, so that the size of what meets the chunk table is known.
    """
    fused = checkpointed(fused, "fused")
    meta = chunks.select(
        "chunk_id", "source", "article_number", "paragraph_number", "chunk_type", "text"
    )
    return hydrate(fused, meta, **limits).select(
        "query_id",
        "rank",
        "chunk_id",
        F.coalesce("source", F.lit("")).alias("source"),
        "article_number",
        "paragraph_number",
        F.coalesce("chunk_type", F.lit(fixed.BODY)).alias("chunk_type"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "similarity",
    )
