"""Answering a table of questions: rewrite, search, fuse, format, prompt."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.functions.topk import CosineScorer
from lexiframe.operators.chunks import hash_embed
from lexiframe.operators.conversation import format_context, prompt_table
from lexiframe.operators.fuse import default_if_unset, format_results, fuse
from lexiframe.operators.rewrite import expand_terms, parse_llm_rewrite, special_pattern, subqueries
from lexiframe.operators.topk_join import rank_within, topk_join
from lexiframe.session import checkpointed

_SEARCH = ["query_id", "list_type", "list_prio", "sub_query", "k"]


def rewrite(questions: DataFrame, terms=None, patterns=None, text: str = "message") -> DataFrame:
    """Questions with legal query, key phrases and static terms.

    ``llm_response`` is the model's raw answer; without that column, or where it is null,
    the dictionary fallback applies.
    """
    if "llm_response" not in questions.columns:
        questions = questions.withColumn("llm_response", F.lit(None).cast("string"))
    matched = special_pattern(expand_terms(questions, terms, text), patterns, text)
    return parse_llm_rewrite(matched, text)


def search_lists(searches: DataFrame, chunks: DataFrame | None, where=None, search=None, **limits) -> DataFrame:
    """Run every search(query_id, list_type, list_prio, sub_query, k, embedding) in one pass.

    All searches of all questions meet the chunk table in a single top-k join, in which equal
    vectors (a question that is its own legal query, say) are one query.  A search whose embedding
    failed (null) returns nothing.  ``search(keyed, k, where)`` takes the place of the scan over all
    chunks, such as ``VectorIndex.searcher()``.
    """
    keyed = checkpointed(searches.where(F.col("embedding").isNotNull()).select(*_SEARCH, "embedding"), "keyed")
    distinct = keyed.select("embedding").distinct().select(F.monotonically_increasing_id().alias("search"), "embedding")
    vectors = checkpointed(distinct, "vectors")
    if search is not None:
        hits = search(vectors, fixed.VECTOR_TOP_K, where)
    else:
        if where is not None:
            chunks = chunks.where(where)
        corpus = chunks.where(F.col("embedding").isNotNull()).select("chunk_id", F.col("embedding").alias("_cv"))
        queries = vectors.withColumnRenamed("embedding", "_qv")
        hits = topk_join(queries, corpus, CosineScorer("_qv", "_cv"), fixed.VECTOR_TOP_K, query_id="search", **limits)
    asked = keyed.join(vectors, "embedding").select(*_SEARCH, "search")
    found = asked.join(hits.select("search", "chunk_id", "similarity"), "search").drop("search")
    # searches may repeat: their hits count as one list
    ranked = rank_within(found, _SEARCH, [F.desc("similarity"), F.col("chunk_id")], fixed.VECTOR_TOP_K)
    names = [c for c in _SEARCH if c != "k"]
    return ranked.where("rank <= k").select(*names, "rank", "chunk_id", "similarity")


def failed_questions(searches: DataFrame) -> DataFrame:
    """Questions whose legal or original search has no embedding: the whole turn fails."""
    return (
        searches.where(F.col("embedding").isNull() & (F.col("list_type") != fixed.ADDITIONAL))
        .select("query_id")
        .distinct()
    )


def searches_of(
    questions: DataFrame, embed=hash_embed, rewriting: bool = True, terms=None, patterns=None
) -> DataFrame:
    """All searches of questions(query_id, message[, llm_response]) with their embedding."""
    rewritten = rewrite(questions, terms, patterns) if rewriting else questions
    return embed(subqueries(rewritten, rewriting=rewriting), text="search_text")


def _results(questions, searches, chunks, fusion, min_cosine, search=None) -> DataFrame:
    hits = search_lists(searches, chunks, search=search)
    if "min_similarity" in questions.columns:
        least = default_if_unset(F.col("min_similarity"), fixed.MIN_SIMILARITY).alias("_least")
        least = questions.select("query_id", least).groupBy("query_id").agg(F.min("_least").alias("_least"))
        hits = hits.join(least, "query_id").where(F.col("similarity") >= F.col("_least")).drop("_least")
    if "top_k" not in questions.columns:
        return format_results(fuse(hits, fusion, min_cosine=min_cosine), chunks)
    limit = default_if_unset(F.col("top_k"), fixed.FINAL_TOP_K)
    ranked = fuse(hits, fusion, top_k=None, min_cosine=min_cosine).join(
        questions.select("query_id", limit.alias("_k")), "query_id"
    )
    return format_results(ranked.where("rank <= _k").drop("_k"), chunks)


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    embed=hash_embed,
    rewriting: bool = True,
    fusion: str = "first_hit",
    min_cosine: float | None = None,
    terms=None,
    patterns=None,
    search=None,
) -> DataFrame:
    """Formatted results of questions(query_id, message[, top_k][, min_similarity][, llm_response]).

    A question's ``min_similarity`` (null and 0: the default) bounds the cosine of every hit.

    ``embed(df, text=...)`` adds the ``embedding`` column and must be the function the
    chunk table was embedded with.  ``search`` replaces the scan over all chunks, which then
    only give the texts of what was found.
    """
    searches = searches_of(questions, embed, rewriting, terms, patterns)
    return _results(questions, searches, chunks, fusion, min_cosine, search)


def answer_prompts(
    questions: DataFrame,
    chunks: DataFrame,
    fusion: str = "first_hit",
    min_cosine: float | None = None,
    search=None,
    **options,
) -> DataFrame:
    """Prompt, or a fixed answer, for every question.

    Where nothing was found the answer says so; a question whose legal or original search
    failed gets the error answer, whatever its other searches found.
    """
    if "history" not in questions.columns:
        questions = questions.withColumn("history", F.lit(""))
    searches = checkpointed(searches_of(questions, **options), "searches")
    results = _results(questions, searches, chunks, fusion, min_cosine, search)
    return prompt_table(questions, format_context(results), failed_questions(searches))
