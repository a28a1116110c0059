"""Approximate nearest neighbours: k-means cells and a probe join.

The number of cells bounds the centroid table.  Cells that hold many chunks, or are probed
by many queries, are split into parts whose size is computed from counts.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexiframe.functions.topk import CosineScorer, array_matrix, best_rows, result_batch
from lexiframe.operators.topk_join import SCORED_BYTES, rank_within, rows_within

MAX_CELLS = 4_096  # bounds the broadcast centres


def train_cells(chunks: DataFrame, cells: int, seed: int = 7, max_iter: int = 10) -> np.ndarray:
    """Unit-length k-means centres of all given vectors; pass fewer rows to train on those."""
    if cells > MAX_CELLS:
        raise ValueError(f"at most {MAX_CELLS} cells")
    chunks = chunks.where(F.exists("embedding", lambda v: v != 0))  # zeros have no direction
    vectors = chunks.select(
        array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features")
    )
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(vectors)
    centres = np.array(model.clusterCenters())
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    norm[norm == 0] = 1.0
    return centres / norm


def assign_cells(df: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """Add ``cells``: the nearest cell numbers, nearest first.  Rows without a vector go."""
    df = df.where(F.col("embedding").isNotNull())
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def nearest(vectors: pa.Array) -> pa.Array:
        sims = array_matrix(vectors) @ shared.value.T if len(vectors) else np.zeros((0, 1))
        width = min(probes, sims.shape[1])
        if width < sims.shape[1]:
            found = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        else:
            found = np.tile(np.arange(width), (len(sims), 1))
        order = np.argsort(-np.take_along_axis(sims, found, 1), axis=1, kind="stable")
        cells = np.take_along_axis(found, order, 1).astype(np.int32)
        offsets = pa.array(np.arange(len(sims) + 1, dtype=np.int32) * width)
        return pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))

    return df.withColumn("cells", nearest.asNondeterministic()("embedding"))


def knn_ivf(
    queries: DataFrame,
    chunks: DataFrame,
    centres: np.ndarray,
    k: int = 10,
    probes: int = 4,
    cell_queries: int | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """k best chunks among the probed cells; probing every cell gives the exact result.

    ``chunks`` carries a ``cell`` column (see ``with_cell``).
    """
    placed = assign_cells(queries.select("query_id", "embedding"), centres, probes).select(
        "query_id", F.col("embedding").alias("_qv"), F.explode("cells").alias("cell")
    )
    rows = chunks.select("chunk_id", "cell", F.col("embedding").alias("_cv"))
    found = knn_cells(placed, rows, k, "query_id", "chunk_id", cell_queries, cell_rows)
    return rank_within(found, ["query_id"], [F.desc("similarity"), "chunk_id"], k)


def knn_cells(
    placed: DataFrame,
    rows: DataFrame,
    k: int,
    query_id: str,
    chunk_id: str,
    cell_queries: int | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """Best rows of every query within the parts of its cells, for query sides of any size.

    ``placed(query_id, _qv, cell)`` meets ``rows(chunk_id, _cv, cell)``.
    """
    cell_queries = cell_queries or rows_within(placed.select("_qv"), SCORED_BYTES)
    cell_rows = cell_rows or rows_within(rows, SCORED_BYTES)

    def parts(df, size, name):
        return df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    plan = parts(rows, cell_rows, "_columns").join(parts(placed, cell_queries, "_stripes"), "cell")

    def mine(key, count):
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = placed.join(plan, "cell").select(
        query_id, "_qv", "cell", mine(query_id, "_stripes").alias("_stripe"),
        every("_columns").alias("_column"),
    )
    right = rows.join(plan, "cell").select(
        chunk_id, "_cv", "cell", mine(chunk_id, "_columns").alias("_column"),
        every("_stripes").alias("_stripe"),
    )
    out = T.StructType(
        [
            T.StructField(query_id, placed.schema[query_id].dataType),
            T.StructField(chunk_id, rows.schema[chunk_id].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    arrow_out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])
    scorer = CosineScorer("_qv", "_cv")

    def score_part(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows == 0 or c.num_rows == 0:
            return arrow_out.empty_table()
        q = q.combine_chunks()
        best = best_rows(scorer, scorer.prepare(q), q.num_rows, c.to_batches(8_192), chunk_id, k)
        return result_batch(q.column(query_id).combine_chunks(), best, arrow_out)

    keys = ["cell", "_column", "_stripe"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score_part, out)


def with_cell(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """Chunk table with its cell number."""
    return assign_cells(chunks, centres, 1).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")


def recall_against(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours the approximate search returned."""
    found = approximate.select("query_id", "chunk_id").withColumn("hit", F.lit(1))
    return (
        exact.join(found, ["query_id", "chunk_id"], "left")
        .agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("neighbours"))
    )
