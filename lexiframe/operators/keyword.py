"""Keyword search: BM25 ranking, substring search, hybrid list assembly."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexiframe.functions import fixed
from lexiframe.functions.text import keyword_tokens
from lexiframe.functions.topk import (
    SCORE_DECIMALS,
    Bm25Scorer,
    keep_best,
    slices,
    array_matrix,
    result_batch,
    unit_rows,
)
from lexiframe.operators.dictionary import ENTRY_BYTES, MAX_BYTES, PatternMatcher
from lexiframe.operators.substrings import bounded_rows, contained, substring_join
from lexiframe.operators.topk_join import TASKS_PER_CORE, rank_within, topk_join
from lexiframe.session import checkpointed

BM25_K1 = 1.2
BM25_B = 0.75
_BROADCAST_QUESTIONS = 512
_CELL_QUESTIONS = 256  # bounds the vocabulary of a scoring block


def bm25(
    questions: DataFrame,
    docs: DataFrame,
    k: int = fixed.VECTOR_TOP_K,
    query_id: str = "query_id",
    query_text: str = "search_text",
    doc_id: str = "chunk_id",
    doc_text: str = "text",
    broadcast_rows: int = _BROADCAST_QUESTIONS,
    cell_queries: int = _CELL_QUESTIONS,
    **limits,
) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents sharing a token.

    Document frequencies are pre-aggregated per task, so a term of every document costs one
    row per task.  Texts are not shuffled: scoring is a top-k join that counts the terms of
    a document where it is read and never forms (question, document) rows.
    """
    text_or_empty = F.coalesce(F.col(doc_text), F.lit(""))
    tokens = docs.select(doc_id, keyword_tokens(text_or_empty).alias("_t"))
    terms = questions.select(
        query_id, F.explode(F.array_distinct(keyword_tokens(F.col(query_text)))).alias("_term")
    )

    # One pass counts documents per term; the empty term stands for the whole table.
    counted = (
        tokens.select(
            F.size("_t").alias("_len"),
            F.explode(F.concat(F.array(F.lit("")), F.array_distinct("_t"))).alias("_term"),
        )
        .groupBy("_term")
        .agg(F.count("*").alias("_df"), F.sum("_len").alias("_total"))
    )
    vocabulary = terms.select("_term").unionByName(
        docs.sparkSession.range(1).select(F.lit("").alias("_term"))
    )
    frequencies = checkpointed(counted.join(vocabulary.distinct(), "_term", "left_semi"))
    table = frequencies.where("_term = ''").first()
    n_docs = float(table["_df"]) if table else 0.0
    avgdl = table["_total"] / n_docs if table and table["_total"] else 1.0

    idf = F.log1p((F.lit(n_docs) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weighted = (
        terms.join(frequencies, "_term")
        .groupBy(query_id)
        .agg(F.sort_array(F.collect_list(F.struct("_term", idf.alias("_w")))).alias("_q"))
        .select(query_id, F.col("_q._term").alias("_qt"), F.col("_q._w").alias("_qw"))
    )
    return topk_join(
        weighted,
        tokens,
        Bm25Scorer("_qt", "_qw", "_t", avgdl, BM25_K1, BM25_B),
        k,
        query_id=query_id,
        corpus_id=doc_id,
        score="score",
        broadcast_rows=broadcast_rows,
        cell_queries=cell_queries,
        **limits,
    )


def containing(
    questions: DataFrame,
    docs: DataFrame,
    query_id: str = "query_id",
    query_text: str = "search_text",
    doc_id: str = "chunk_id",
    doc_text: str = "text",
    literal_patterns: int = 128,
) -> DataFrame:
    """(query_id, doc_id) where the document contains the question text verbatim.

    A few questions are tested one by one against every text; more meet the texts through
    their words.
    """
    rows = bounded_rows(questions, [query_id, query_text], literal_patterns)
    if rows is not None:
        entries = [(r[query_text], F.lit(r[query_id])) for r in rows if r[query_text] is not None]
        return docs.select(
            doc_id, F.explode(contained(F.col(doc_text), entries)).alias(query_id)
        ).select(query_id, doc_id)
    return substring_join(
        docs.select(doc_id, F.col(doc_text).alias("_text")),
        questions.select(query_id, F.col(query_text).alias("_pattern")),
        doc_id,
        "_text",
        "_pattern",
    ).select(query_id, doc_id)


def search_by_text(
    questions: DataFrame,
    docs: DataFrame,
    k: int = fixed.VECTOR_TOP_K,
    where=None,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Documents containing the question, nearest embedding first.

    Both tables carry ``embedding``; rows without text or vector take no part.  All questions are found
    in one pass over a document, in the task that reads it, and each task keeps its best k of a
    question: matches are never written or shuffled.  Question tables above ``max_bytes`` go in
    stripes, one scan each.
    """
    if where is not None:
        docs = docs.where(where)
    complete = F.col("embedding").isNotNull()
    asked = questions.select("query_id", "search_text", "embedding").where(complete & F.col("search_text").isNotNull())
    asked = checkpointed(asked, "questions")
    size = F.octet_length("search_text") + 8 * F.size("embedding") + ENTRY_BYTES
    stripes = -(-(asked.agg(F.sum(size.cast("bigint"))).first()[0] or 0) // max_bytes) or 1
    docs = docs.select("chunk_id", "text", "embedding").where(complete & F.col("text").isNotNull())
    found = None
    for stripe in range(stripes):
        own = F.pmod(F.xxhash64("query_id", "search_text"), F.lit(stripes)) == stripe
        hits = _matches_in_place(asked.where(own) if stripes > 1 else asked, docs, k)
        found = hits if found is None else found.unionByName(hits)
    return rank_within(found, ["query_id"], [F.desc("similarity"), "chunk_id"], k)


def _matches_in_place(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Up to k rows per question and task: the nearest documents that contain it."""
    shared = docs.sparkSession.sparkContext.broadcast(asked.toArrow().combine_chunks())
    out = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("chunk_id", docs.schema["chunk_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def run(batches):
        held = shared.value
        names = pa.chunked_array(held.column("query_id")).combine_chunks()
        unit = unit_rows(array_matrix(held.column("embedding"))) if held.num_rows else None
        matcher = PatternMatcher(held.column("search_text").to_pylist())
        best = (np.zeros(0, np.int64), np.zeros(0), None)
        for batch in slices(batches, 1_024):
            met = [matcher.numbers(t) for t in batch.column("text").to_pylist()]
            question = np.fromiter((n for m in met for n in m), np.int64)
            if not len(question):
                continue
            row = np.repeat(np.arange(batch.num_rows), [len(m) for m in met])
            rows = unit_rows(array_matrix(batch.column("embedding")))
            near = np.concatenate(
                [
                    np.einsum("ij,ij->i", unit[question[i : i + 65_536]], rows[row[i : i + 65_536]])
                    for i in range(0, len(row), 65_536)
                ]
            )
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)[row]
            found = (question, np.round(near, SCORE_DECIMALS), ids)
            parts = [found] if best[2] is None else [best, found]
            best = keep_best(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
        yield from result_batch(names, best, schema).to_batches(max_chunksize=65_536)

    tasks = TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(tasks).mapInArrow(run, out)


def cosine(a: str, b: str):
    """Cosine of two vector columns in double precision; 0 where either is zero."""
    def dot(x, y):
        products = F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    lengths = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def hybrid_hits(vector_hits: DataFrame, keyword_hits: DataFrame, list_type="keyword") -> DataFrame:
    """Stack vector lists and one keyword list for fusion."""
    keyword = keyword_hits.select(
        "query_id",
        F.lit(list_type).alias("list_type"),
        F.lit(3).alias("list_prio"),
        F.lit(0).alias("sub_query"),
        "rank",
        "chunk_id",
        F.lit(None).cast("double").alias("similarity"),
    )
    return vector_hits.select(*keyword.columns).unionByName(keyword)
