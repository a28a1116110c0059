"""Inverted index for BM25: postings written once by term, read by need, scored exactly.

Documents are cut into segments of bounded size while their tokens are counted, in one scan and
without a shuffle.  Each segment yields one block per term: the places of the documents with the term,
their weights (the part of the BM25 score that does not depend on the query) and the largest of them.
So a term of every document is as many blocks as there are segments, never one long list.  Blocks are
stored partitioned by a hash of their term, with term statistics and document ids beside them.

A search never scores questions against documents that share no term with them, and reads a question's
postings in three steps:

1. its terms with the highest bounds (inverse document frequency times largest weight), up to half of
   the sum; the k-th best sum of these is a score that the k-th result reaches at least;
2. terms are essential unless the bounds of all terms up to theirs, from the smallest, stay below that
   score: a document with other terms alone cannot be among the k best.  The essential postings give
   the candidates, less those that cannot reach the score even with all other bounds;
3. the other terms, typically the frequent ones, are read in the segments that still have candidates.

Every step is a scan pruned to the partitions of its terms, a shuffle of their blocks by segment, and a
sum of arrays in tasks of one segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexiframe.functions import fixed
from lexiframe.functions.text import keyword_tokens
from lexiframe.functions.topk import SCORE_DECIMALS
from lexiframe.operators.topk_join import rank_within
from lexiframe.session import checkpointed
from lexiframe.sources.snapshots import VersionedTable

K1 = 1.2
B = 0.75
BUCKETS = 16
SEGMENT_DOCS = 4_096
SEGMENT_TOKENS = 1 << 21
STRIPE_TERMS = 1 << 18  # (question, term) rows sent to the tasks at once
MARGIN = 1e-6  # of a score, far above what rounding can change


# ---------------------------------------------------------------- building


def segment_blocks(ids: pa.Array, tokens: pa.ListArray, segment: int, schema: pa.Schema) -> pa.Table:
    """Blocks of one segment; the row without a term lists its documents, by id, with their lengths.

    ``tokens`` are lists of strings or of dictionary codes.
    """
    order = pc.sort_indices(pa.table({"id": ids}), [("id", "ascending")], null_placement="at_start")
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int32)
    many = len(ids)
    place = np.empty(many, np.int32)
    place[order.to_numpy()] = np.arange(many, dtype=np.int32)
    flat = tokens.flatten()
    coded = flat if pa.types.is_dictionary(flat.type) else flat.dictionary_encode()
    cells = coded.indices.to_numpy().astype(np.int64)  # of a term and a document; the one array of a segment's tokens
    cells *= many
    cells += np.repeat(place, lengths)
    cells.sort()
    new = np.flatnonzero(np.diff(cells, prepend=-1))
    counts = np.diff(np.append(new, len(cells))).astype(np.int32)
    cells = cells[new]
    ids, lengths = ids.take(order), lengths[order.to_numpy()]
    term, at = cells // max(many, 1), (cells % max(many, 1)).astype(np.int32)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(term)) + 1)) if len(term) else np.empty(0, np.int64)
    ends = np.append(starts, len(term)).astype(np.int32)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    blocks = {
        "segment": pa.array(np.full(len(starts), segment, np.int64)),
        "term": coded.dictionary.take(pa.array(term[starts])),
        "at": lists(at),
        "tf": lists(counts),
        "len": lists(lengths[at]),
        "ids": pa.nulls(len(starts), schema.field("ids").type),
    }
    whole = {
        "segment": pa.array([segment], pa.int64()),
        "term": pa.nulls(1, pa.string()),
        "at": pa.nulls(1, schema.field("at").type),
        "tf": pa.nulls(1, schema.field("tf").type),
        "len": pa.array([lengths.tolist()], schema.field("len").type),
        "ids": pa.ListArray.from_arrays(pa.array([0, many], pa.int32()), ids),
    }
    return pa.concat_tables([pa.table(part).cast(schema) for part in (whole, blocks)])


def _raw_blocks(docs: DataFrame, key: str, text: str, segment_docs: int) -> DataFrame:
    kind = docs.schema[key].dataType
    numbers = T.ArrayType(T.IntegerType())
    out = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("term", T.StringType()),
            T.StructField("at", numbers),
            T.StructField("tf", numbers),
            T.StructField("len", numbers),
            T.StructField("ids", T.ArrayType(kind)),
        ]
    )
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    step = min(256, segment_docs)

    def run(batches):
        held, rows, tokens = [], 0, 0
        number = TaskContext.get().partitionId() << 32

        def flush():
            ids, sizes, coded = zip(*held, strict=True)
            flat = pa.chunked_array(coded).unify_dictionaries().combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32()), flat)
            return segment_blocks(pa.concat_arrays(ids), lists, number, schema).to_batches(max_chunksize=8_192)

        for batch in batches:
            for first in range(0, batch.num_rows, step):
                piece = batch.slice(first, step)
                # copies: a slice would keep its whole batch, with the text of every token
                lists = piece.column(1)
                ids = piece.column(0).take(pa.array(np.arange(piece.num_rows)))
                held.append((ids, pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()))
                rows += piece.num_rows
                tokens += len(held[-1][2])
                if rows >= segment_docs or tokens >= SEGMENT_TOKENS:
                    yield from flush()
                    held, rows, tokens, number = [], 0, 0, number + 1
        if rows:
            yield from flush()

    found = docs.select(key, keyword_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    return found.mapInArrow(run, out)


class PostingsIndex:
    """One version of an index over ``docs(chunk_id, text)``."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.table = spark, VersionedTable(spark, path)
        found = self.table.manifest(version)
        self.version, self.facts = found["version"], found["facts"]
        if "terms" not in self.facts:
            raise ValueError(f"{path} is no postings index")

    @classmethod
    def build(
        cls,
        spark: SparkSession,
        path: str,
        docs: DataFrame,
        key: str = "chunk_id",
        text: str = "text",
        buckets: int = BUCKETS,
        segment_docs: int = SEGMENT_DOCS,
        k1: float = K1,
        b: float = B,
    ) -> PostingsIndex:
        """Write the index as a new version and open it; texts are tokenised once."""
        table = VersionedTable(spark, path)
        base = table.latest()
        raw = checkpointed(_raw_blocks(docs, key, text, segment_docs), "blocks")
        whole = raw.where(F.col("term").isNull())
        total = F.aggregate("len", F.lit(0).cast("bigint"), lambda s, n: s + n)
        size = whole.agg(F.sum(F.size("ids")).alias("n"), F.sum(total).alias("tokens")).first()
        documents, mean = size.n or 0, (size.tokens or 0) / max(size.n or 0, 1) or 1.0

        def weight(count, length):
            norm = F.lit(1.0 - b) + F.lit(b) * length / F.lit(mean)
            return count * F.lit(k1 + 1.0) / (count + F.lit(k1) * norm)

        weights = F.zip_with("tf", "len", weight)
        blocks = raw.where(F.col("term").isNotNull()).select(
            "segment", "term", F.size("at").alias("n"), "at", weights.alias("weights"),
            F.array_max(weights).alias("top"), F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"),
        )
        spread = blocks.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "segment")
        folder = table.write_data(spread, ("bucket",))
        stored = spark.read.schema(blocks.schema).parquet(f"{table.path}/data/{folder}")
        terms = stored.groupBy("term", "bucket").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
        ids = whole.select("segment", F.posexplode("ids").alias("at", key))
        facts = {"terms": table.write_data(terms), "documents": table.write_data(ids), "count": documents, "key": key}
        table.commit([folder], blocks.schema, base, "build", ("bucket",), facts)
        return cls(spark, path)

    def _beside(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.table.path}/data/{self.facts[name]}")

    def terms(self) -> DataFrame:
        """``term, bucket, df, top`` of every term."""
        return self._beside("terms")

    def blocks(self) -> DataFrame:
        return self.table.read(self.version)

    # ------------------------------------------------------------ searching

    def weigh(self, questions: DataFrame, query_id: str = "query_id", query_text: str = "search_text") -> DataFrame:
        """``query, term, bucket, idf, ub``: the known terms of every question.

        Rows that share an id are one question.
        """
        words = F.explode(keyword_tokens(F.col(query_text))).alias("term")
        asked = questions.select(F.col(query_id).alias("query"), words).distinct()
        odds = (F.lit(float(self.facts["count"])) - F.col("df") + 0.5) / (F.col("df") + 0.5)
        known = asked.join(self.terms(), "term").withColumn("idf", F.log1p(odds))
        return known.select("query", "term", "bucket", "idf", (F.col("idf") * F.col("top")).alias("ub"))

    def search(
        self,
        questions: DataFrame,
        k: int = fixed.VECTOR_TOP_K,
        query_id: str = "query_id",
        query_text: str = "search_text",
        stripe_terms: int = STRIPE_TERMS,
    ) -> DataFrame:
        """``query_id, chunk_id, score, rank`` of the k best documents sharing a token.

        Question sides above ``stripe_terms`` rows go in stripes, one after the other.
        """
        weighed = checkpointed(self.weigh(questions, query_id, query_text), "weighed")
        stripes = -(-weighed.count() // stripe_terms) or 1
        found = None
        for stripe in range(stripes):
            part = weighed if stripes == 1 else weighed.where(F.pmod(F.xxhash64("query"), F.lit(stripes)) == stripe)
            hits = self._search(part, k)
            found = hits if found is None else found.unionByName(hits)
        key = self.facts["key"]
        near = checkpointed(found, "hits")
        named = self._beside("documents").join(F.broadcast(near) if near.count() <= STRIPE_TERMS else near, ["segment", "at"])
        named = named.select(F.col("query").alias(query_id), key, "score")
        return rank_within(named, [query_id], [F.desc("score"), F.col(key)], k)

    def _needed(self, wanted: DataFrame) -> DataFrame:
        """Blocks of the wanted terms; other partitions are not read."""
        keys = wanted.select("term", "bucket").distinct()
        return self.blocks().join(F.broadcast(keys), ["bucket", "term"], "left_semi").select("segment", "term", "at", "weights")

    def _search(self, weighed: DataFrame, k: int) -> DataFrame:
        """``query, segment, at, score``: up to k documents of every segment that may be among the k best."""
        own = Window.partitionBy("query")
        down = own.orderBy(F.desc("ub"), "term").rowsBetween(Window.unboundedPreceding, -1)
        first = weighed.withColumn("before", F.coalesce(F.sum("ub").over(down), F.lit(0.0)))
        first = checkpointed(first.withColumn("half", F.sum("ub").over(own) / 2), "first").where("before < half")
        partial = self._scored(first.withColumn("rest", F.lit(0.0)).withColumn("least", F.lit(0.0)), k)
        best = rank_within(partial.select("query", "score"), ["query"], [F.desc("score")], k)
        least = best.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        up = own.orderBy("ub", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        judged = weighed.join(F.broadcast(least.select("query", "least")), "query", "left").withColumns(
            {"least": F.coalesce("least", F.lit(0.0)) - MARGIN, "below": F.sum("ub").over(up)}
        )
        skipped = F.when(F.col("below") < F.col("least"), F.col("ub")).otherwise(0.0)
        judged = checkpointed(judged.withColumn("rest", F.sum(skipped).over(own)), "judged")
        found = checkpointed(self._scored(judged.where("below >= least"), k), "candidates")
        rest = judged.where("below < least")
        if rest.isEmpty():
            return found.select("query", "segment", "at", "score")
        done = found.where("open = false").select("query", "segment", "at", "score")
        return done.unionByName(self._finished(found.where("open"), rest, k))

    def _scored(self, wanted: DataFrame, k: int) -> DataFrame:
        """``query, segment, at, score, open`` over the wanted terms of each question.

        A question without other terms keeps its k best of a segment; one with others keeps, as
        open, every document that can still reach ``least`` and the segment's own k-th sum.
        """
        shared = self.spark.sparkContext.broadcast(_Questions.of(wanted).parts)
        kind = wanted.schema["query"].dataType
        out, schema = _hit_schema(kind, T.StructField("open", T.BooleanType()))

        def score(blocks: pa.Table) -> pa.Table:
            held = _Questions(*shared.value)
            lists, many = _block_lists(blocks)
            rows, places, sums, still = [], [], [], []
            for query, own in held.present(lists):
                total = _summed(own, lists, many)
                at = np.flatnonzero(total > 0)
                if held.rest[query] > 0:
                    floor = held.least[query]
                    if len(at) > k:
                        floor = max(floor, np.partition(total[at], len(at) - k)[len(at) - k] - MARGIN)
                    at = at[total[at] + held.rest[query] >= floor]
                else:
                    total = np.round(total, SCORE_DECIMALS)
                    at = at[np.lexsort((at, -total[at]))[:k]]
                rows.append(np.full(len(at), query))
                places.append(at)
                sums.append(total[at])
                still.append(np.full(len(at), held.rest[query] > 0))
            return _hits(held.names, blocks, rows, places, [sums, still], schema)

        return self._needed(wanted).groupBy("segment").applyInArrow(score, out)

    def _finished(self, candidates: DataFrame, rest: DataFrame, k: int) -> DataFrame:
        """Full scores of the candidates: the other terms are read where there are any."""
        shared = self.spark.sparkContext.broadcast(_Questions.of(rest.withColumn("rest", F.lit(0.0))).parts)
        there = candidates.select("query", "segment").distinct().join(F.broadcast(rest.select("query", "term", "bucket")), "query")
        there = checkpointed(there.select("segment", "term").distinct(), "there")
        blocks = self._needed(rest).join(there, ["segment", "term"], "left_semi")
        kind = candidates.schema["query"].dataType
        out, schema = _hit_schema(kind)

        def finish(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return schema.empty_table()
            held = _Questions(*shared.value)
            lists, many = _block_lists(right)
            at = left.column("at").to_numpy()
            many = max(many, int(at.max()) + 1)
            query = pc.index_in(left.column("query").combine_chunks(), held.names).to_numpy(zero_copy_only=False)
            base, terms = left.column("score").to_numpy(), held.by_query
            rows, places, sums = [], [], []
            for one in np.unique(query):
                mine = np.flatnonzero(query == one)
                total = base[mine] + _summed(terms[int(one)], lists, many)[at[mine]]
                total = np.round(total, SCORE_DECIMALS)
                best = np.lexsort((at[mine], -total))[:k]
                rows.append(np.full(len(best), one))
                places.append(at[mine][best])
                sums.append(total[best])
            return _hits(held.names, left, rows, places, [sums], schema)

        return candidates.groupBy("segment").cogroup(blocks.groupBy("segment")).applyInArrow(finish, out)


def _hit_schema(kind, *more):
    fields = [T.StructField("query", kind), T.StructField("segment", T.LongType()),
              T.StructField("at", T.IntegerType()), T.StructField("score", T.DoubleType()), *more]
    return T.StructType(fields), pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])


class _Questions:
    """Terms of a bounded set of questions, as every task holds them."""

    def __init__(self, names: pa.Array, by_query: list[list[tuple[str, float]]], rest, least):
        self.names, self.by_query, self.rest, self.least = names, by_query, rest, least

    @property
    def parts(self) -> tuple:
        """What is broadcast: no class of this package, which executors do not have."""
        return self.names, self.by_query, self.rest, self.least

    @classmethod
    def of(cls, wanted: DataFrame) -> _Questions:
        table = wanted.select("query", "term", "idf", "rest", "least").toArrow().combine_chunks()
        name = table.column("query").combine_chunks() if isinstance(table.column("query"), pa.ChunkedArray) else table.column("query")
        names = name.unique()
        number = pc.index_in(name, names).to_numpy(zero_copy_only=False)
        by_query: list[list[tuple[str, float]]] = [[] for _ in range(len(names))]
        rest, least = np.zeros(len(names)), np.zeros(len(names))
        columns = (table.column(c).to_pylist() for c in ("term", "idf", "rest", "least"))
        for n, term, idf, other, floor in zip(number.tolist(), *columns, strict=True):
            by_query[n].append((term, idf))
            rest[n], least[n] = other, floor
        return cls(names, by_query, rest, least)

    def present(self, lists):
        """Questions with a term in the segment, and their terms."""
        for query, terms in enumerate(self.by_query):
            if any(t in lists for t, _ in terms):
                yield query, terms


def _block_lists(blocks: pa.Table) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], int]:
    """Places and weights by term, and the number of places needed."""
    lists, many = {}, 0
    for batch in blocks.to_batches():
        at, weights = batch.column("at"), batch.column("weights")
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False))))
        places, values = at.flatten().to_numpy(), weights.flatten().to_numpy()
        for i, term in enumerate(batch.column("term").to_pylist()):
            lists[term] = places[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]]
        if len(places):
            many = max(many, int(places.max()) + 1)
    return lists, many


def _summed(terms, lists, many: int) -> np.ndarray:
    """Sum of idf times weight per place."""
    there = [(lists[t], idf) for t, idf in terms if t in lists]
    if not there:
        return np.zeros(many)
    places = np.concatenate([at for (at, _), _ in there])
    return np.bincount(places, np.concatenate([w * idf for (_, w), idf in there]), many)


def _hits(names, group: pa.Table, rows, places, values, schema: pa.Schema) -> pa.Table:
    if not rows:
        return schema.empty_table()
    query = pa.array(np.concatenate(rows).astype(np.int64))
    segment = np.full(len(query), group.column("segment")[0].as_py(), np.int64)
    columns = [names.take(query), pa.array(segment), pa.array(np.concatenate(places).astype(np.int32))]
    return pa.table([*columns, *(pa.array(np.concatenate(v)) for v in values)], schema=schema)
