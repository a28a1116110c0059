"""Top-k join: for every query row, the k best-scoring corpus rows.

Small query sides (checked) are broadcast and the corpus is read once without a
shuffle; each task keeps only its running best k per query.  Beyond the bound both sides
are hashed onto a grid of cells of bounded bytes, several for every core, and cells are scored
independently.  Neither way forms query x corpus rows in Spark.

Every task returns up to k rows per query, so the number of tasks, not the corpus, sets the
size of the final merge; tasks therefore read several splits each.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexiframe.functions.topk import best_rows, result_batch
from lexiframe.session import checkpointed

BROADCAST_ROWS = 16_384
BROADCAST_BYTES = 256 << 20
CELL_BYTES = 64 << 20
SCORED_BYTES = 16 << 20  # of either side of a cell of vectors; scoring holds several copies of them
LEAST_PAIRS = 1 << 26  # query rows x corpus rows that are worth a cell of their own
MOST_PARTITIONS = 1 << 13
TASKS_PER_CORE = 4


def topk_join(
    queries: DataFrame,
    corpus: DataFrame,
    scorer,
    k: int,
    query_id: str = "query_id",
    corpus_id: str = "chunk_id",
    score: str = "similarity",
    broadcast_rows: int = BROADCAST_ROWS,
    cell_queries: int | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """(query_id, corpus_id, score, rank); rank is 1-based, ties ordered by corpus id."""
    out = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(corpus_id, corpus.schema[corpus_id].dataType),
            T.StructField(score, T.DoubleType()),
        ]
    )
    arrow_out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    shared = bounded_table(queries, query_id, broadcast_rows)
    if shared is not None:
        tasks = TASKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism

        def score_partition(batches):
            table = shared.value.combine_chunks()
            state = scorer.prepare(table)
            best = best_rows(scorer, state, table.num_rows, batches, corpus_id, k)
            yield from result_batch(
                table.column(query_id).combine_chunks(), best, arrow_out
            ).to_batches(max_chunksize=65_536)

        partial = corpus.coalesce(tasks).mapInArrow(score_partition, out)
    else:
        partial = _grid(
            queries, corpus, scorer, k, query_id, corpus_id, cell_queries, cell_rows, out, arrow_out
        )
    return rank_within(partial, [query_id], [F.desc(score), F.col(corpus_id)], k)


def bounded_table(queries: DataFrame, query_id: str, rows: int = BROADCAST_ROWS, written: bool = False):
    """Broadcast of the query rows, or None when they exceed the bound in rows or bytes.

    Ids are counted first; a side that has few enough is then written once (unless it is ``written``),
    and its array elements are added up in Spark before anything reaches the driver.
    """
    if queries.select(query_id).limit(rows + 1).count() > rows:
        return None
    wide = [f.name for f in queries.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not written:
        queries = checkpointed(queries, "queries")
    if wide:
        values = sum((F.coalesce(F.size(c), F.lit(0)) for c in wide), F.lit(0)).cast("bigint")
        if (queries.agg(F.sum(values)).first()[0] or 0) * 8 > BROADCAST_BYTES:
            return None
    table = queries.toArrow()
    if table.nbytes > BROADCAST_BYTES:
        return None
    return queries.sparkSession.sparkContext.broadcast(table)


def rows_within(df: DataFrame, budget: int, sample: int = 256) -> int:
    """Rows of the table that fit the byte budget, from the width of its first rows."""
    head = df.limit(sample).toArrow()
    return max(256, budget // max(head.nbytes // max(head.num_rows, 1), 1))


def grid_shape(queries: int, rows: int, cell_queries: int, cell_rows: int, cores: int) -> tuple[int, int]:
    """Stripes of queries and columns of corpus rows: cells within their bounds, and enough of them for the cores."""
    stripes, columns = -(-queries // cell_queries) or 1, -(-rows // cell_rows) or 1
    wanted = min(TASKS_PER_CORE * cores, queries * rows // LEAST_PAIRS)
    while stripes * columns < wanted:
        # cutting the longer side copies fewer rows
        if queries * columns >= rows * stripes:
            stripes += 1
        else:
            columns += 1
    return stripes, columns


def _grid(
    queries, corpus, scorer, k, query_id, corpus_id, cell_queries, cell_rows, out, arrow_out
):
    cores = queries.sparkSession.sparkContext.defaultParallelism
    bounds = (
        cell_queries or rows_within(queries, SCORED_BYTES),
        cell_rows or rows_within(corpus, SCORED_BYTES),
    )
    stripes, columns = grid_shape(queries.count(), corpus.select(corpus_id).count(), *bounds, cores)

    def mine(key, count):
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    # a number of partitions that is given stays: few bytes can be much work
    partitions = min(2 * stripes * columns, MOST_PARTITIONS)

    def placed(df, stripe, column):
        cells = df.withColumn("_stripe", stripe).withColumn("_column", column)
        cell = (F.col("_stripe") * columns + F.col("_column")).alias("_cell")
        return cells.select(*df.columns, cell).repartition(partitions, "_cell").groupBy("_cell")

    def score_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return arrow_out.empty_table()
        left = left.combine_chunks()
        best = best_rows(
            scorer, scorer.prepare(left), left.num_rows, right.to_batches(8_192), corpus_id, k
        )
        return result_batch(left.column(query_id).combine_chunks(), best, arrow_out)

    return (
        placed(queries, mine(query_id, stripes), every(columns))
        .cogroup(placed(corpus, every(stripes), mine(corpus_id, columns)))
        .applyInArrow(score_cell, out)
    )


def rank_within(df: DataFrame, keys, order, k=None, name: str = "rank") -> DataFrame:
    """1-based rank inside each key; with k, Spark limits each group before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(name) <= k)
