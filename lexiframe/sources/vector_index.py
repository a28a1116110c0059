"""Vector index on storage: chunks partitioned by cell, searched by reading the probed cells alone.

The index is a versioned table whose data folders are partitioned by cell (and spread over ``parts`` of
a hot one), with the centres of the two-level quantiser beside them.  A search finds the cells of its
queries, and the scan is pruned to those cells by the planner's dynamic partition pruning; everything
else stays unread.  What is read is scored exactly, so probing every cell gives the exact result.

    index = VectorIndex.build(spark, path, chunks, coarse=64, fine=64)
    hits = index.search(queries, k=10)                      # queries(query_id, embedding)
    results = retrieve(questions, chunks, search=index.searcher())
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexiframe.functions import fixed
from lexiframe.functions.topk import SCORE_DECIMALS, array_matrix, best_cells, keep_best, result_batch, unit_rows
from lexiframe.operators.cells import ROUNDS, Quantiser, train_quantiser, with_cells, with_probes
from lexiframe.operators.ivf import knn_cells
from lexiframe.operators.topk_join import TASKS_PER_CORE, bounded_table, rank_within
from lexiframe.session import checkpointed
from lexiframe.sources.snapshots import VersionedTable

COARSE_PROBES = 4
PROBES = 16
PRUNED_CELLS = 1 << 16  # cell numbers the planner may send to prune a scan


class VectorIndex:
    """One version of an index; later builds and additions do not change what it reads."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.table = spark, VersionedTable(spark, path)
        found = self.table.manifest(version)
        self.version, facts = found["version"], found["facts"]
        if "centres" not in facts:
            raise ValueError(f"{path} is no vector index")
        self.centres = facts["centres"]
        rows = spark.read.parquet(f"{self.table.path}/data/{self.centres}").orderBy("level", "number").toArrow()
        level, matrix = rows.column("level").to_numpy(), array_matrix(rows.column("centre"))
        self.quantiser = Quantiser(matrix[level == 0], matrix[level == 1], np.array(facts["starts"]))

    # ------------------------------------------------------------ writing

    @classmethod
    def build(
        cls,
        spark: SparkSession,
        path: str,
        chunks: DataFrame,
        coarse: int = 64,
        fine: int = 64,
        key: str = "chunk_id",
        coarse_centres: np.ndarray | None = None,
        rounds: int = ROUNDS,
    ) -> VectorIndex:
        """Write ``chunks(chunk_id, embedding, ...)`` as a new version and open it.

        Chunks without a vector are not in the index.  Other columns are kept for filters.  ``rounds``
        bounds the k-means of the cells.
        """
        table = VersionedTable(spark, path)
        base = table.latest()
        quantiser = train_quantiser(chunks, coarse, fine, key, coarse_centres, rounds)
        centres = [(0, i, c.tolist()) for i, c in enumerate(quantiser.coarse)]
        centres += [(1, i, c.tolist()) for i, c in enumerate(quantiser.fine)]
        stored = table.write_data(spark.createDataFrame(centres, "level int, number int, centre array<double>").coalesce(1))
        cls._commit(table, [], chunks, quantiser, base, "build", {"centres": stored, "starts": quantiser.starts.tolist()})
        return cls(spark, path)

    def add(self, chunks: DataFrame) -> VectorIndex:
        """New version with more chunks in the same cells; raises if this is not the newest one."""
        found = self.table.manifest(self.version)
        facts = found["facts"]
        self._commit(self.table, found["folders"], chunks, self.quantiser, self.version, "add", facts)
        return VectorIndex(self.spark, self.table.path)

    @staticmethod
    def _commit(table, folders, chunks, quantiser, base, operation, facts):
        placed = with_cells(chunks, quantiser)
        # a cell's rows are dealt over as many tasks as the planner finds right for their size
        folder = table.write_data(placed.hint("rebalance", F.col("cell")), ("cell",))
        table.commit([*folders, folder], placed.schema, base, operation, ("cell",), facts)

    # ------------------------------------------------------------ reading

    def read(self) -> DataFrame:
        """All chunks with their cell."""
        return self.table.read(self.version)

    def placed(self, queries: DataFrame, coarse_probes: int, probes: int, query_id: str) -> DataFrame:
        """``query, qv, probe, cell``: a row per query and cell to search, written once."""
        found = with_probes(queries.select(F.col(query_id).alias("query"), "embedding"), self.quantiser, coarse_probes, probes)
        found = found.select("query", F.col("embedding").alias("qv"), F.posexplode("cells").alias("probe", "cell"))
        return checkpointed(found, "probes")

    def candidates(self, placed: DataFrame, probes: int, where=None) -> DataFrame:
        """Chunks of the probed cells; the scan reads these cells' folders only."""
        chunks = self.read() if where is None else self.read().where(where)
        wanted = placed.where(F.col("probe") < probes).select("cell").distinct()
        if wanted.limit(PRUNED_CELLS + 1).count() <= PRUNED_CELLS:
            wanted = F.broadcast(wanted)
        return chunks.join(wanted, "cell", "left_semi")

    def search(
        self,
        queries: DataFrame,
        k: int = fixed.VECTOR_TOP_K,
        coarse_probes: int = COARSE_PROBES,
        probes: int = PROBES,
        where=None,
        query_id: str = "query_id",
        key: str = "chunk_id",
    ) -> DataFrame:
        """``query_id, chunk_id, similarity, rank``: the k best chunks of the probed cells."""
        placed = self.placed(queries, coarse_probes, probes, query_id)
        chunks = self.candidates(placed, probes, where).select(key, "cell", F.col("embedding").alias("_cv"))
        out = T.StructType(
            [
                T.StructField(query_id, placed.schema["query"].dataType),
                T.StructField(key, chunks.schema[key].dataType),
                T.StructField("similarity", T.DoubleType()),
            ]
        )
        shared = bounded_table(placed.select("query", "qv", "cell"), "cell", written=True)
        if shared is None:
            renamed = placed.select(F.col("query").alias(query_id), F.col("qv").alias("_qv"), "cell")
            found = knn_cells(renamed, chunks, k, query_id, key)
        else:
            found = _scored_in_place(shared, chunks, k, key, out)
        return rank_within(found, [query_id], [F.desc("similarity"), F.col(key)], k)

    def searcher(self, **options):
        """Search function for ``plans.answer``: takes the keyed searches and the number of results."""

        def run(keyed: DataFrame, k: int, where=None) -> DataFrame:
            return self.search(keyed, k, where=where, query_id="search", **options)

        return run


def _scored_in_place(shared, chunks: DataFrame, k: int, key: str, out: T.StructType) -> DataFrame:
    """Best rows per query and task: the queries of a cell meet the chunks of that cell where they are read."""
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def run(batches):
        table = shared.value.combine_chunks()
        query_cell = table.column("cell").to_numpy()
        unit = unit_rows(array_matrix(table.column("qv"))) if table.num_rows else np.zeros((0, 0))
        by_cell = np.argsort(query_cell, kind="stable")
        cells, starts = np.unique(query_cell[by_cell], return_index=True)
        asking = dict(zip(cells.tolist(), np.split(by_cell, starts[1:]), strict=False))
        best = (np.zeros(0, np.int64), np.zeros(0), None)
        for batch in batches:
            here = batch.column("cell").to_numpy(zero_copy_only=False)
            ids = batch.column(key).to_numpy(zero_copy_only=False)
            for cell in np.unique(here):
                queries = asking.get(int(cell))
                rows = np.flatnonzero(here == cell)
                if queries is None:
                    continue
                rows = rows[np.argsort(ids[rows], kind="stable")]
                vectors = unit_rows(array_matrix(batch.column("_cv").take(pa.array(rows))))
                scores = np.round(unit[queries] @ vectors.T, SCORE_DECIMALS)
                r, c = np.nonzero(best_cells(scores, k))
                found = (queries[r], scores[r, c], ids[rows][c])
                parts = [found] if best[2] is None else [best, found]
                best = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            if best[2] is not None and len(best[0]):
                best = keep_best(*best, k)
        yield from result_batch(table.column("query").combine_chunks(), best, schema).to_batches(max_chunksize=65_536)

    tasks = TASKS_PER_CORE * chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.coalesce(tasks).mapInArrow(run, out)
