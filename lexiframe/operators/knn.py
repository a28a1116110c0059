"""Nearest-neighbour search of embedded queries in an embedded chunk table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.functions.topk import CosineScorer
from lexiframe.operators.topk_join import topk_join


def knn(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = fixed.VECTOR_TOP_K,
    where=None,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    embedding: str = "embedding",
    **limits,
) -> DataFrame:
    """k nearest chunks per query by cosine similarity, nearest first.

    ``where`` is a metadata predicate on the chunk table; it is applied before the search
    and reaches the scan as a pushed filter.
    """
    if where is not None:
        chunks = chunks.where(where)
    q = queries.select(query_id, F.col(embedding).alias("_qv")).where(F.col("_qv").isNotNull())
    c = chunks.select(chunk_id, F.col(embedding).alias("_cv")).where(F.col("_cv").isNotNull())
    return topk_join(
        q, c, CosineScorer("_qv", "_cv"), k, query_id=query_id, corpus_id=chunk_id, **limits
    )
