"""Chunk table bucketed by id: joins on the id read it bucket by bucket, without a shuffle.

The files of a bucketed table carry their bucket in their names, so any session can open the folder
again; the table's name exists in the session's catalog only.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexiframe.sources.snapshots import VersionedTable

BUCKETS = 64


class BucketedChunks:
    """One version of a bucketed table."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.table = spark, VersionedTable(spark, path)
        found = self.table.manifest(version)
        self.version, self.schema, self.facts = found["version"], T.StructType.fromJson(found["schema"]), found["facts"]
        if "buckets" not in self.facts:
            raise ValueError(f"{path} is not bucketed")
        self.folder = f"{self.table.path}/data/{found['folders'][0]}"

    @classmethod
    def write(cls, spark: SparkSession, path: str, chunks: DataFrame, buckets: int = BUCKETS, key: str = "chunk_id"):
        """Write ``chunks`` as a new version: one shuffle by id, then files sorted by id within buckets."""
        table = VersionedTable(spark, path)
        base = table.latest()
        folder = hashlib.sha256(f"{path}/{base + 1}/{spark.sparkContext.applicationId}".encode()).hexdigest()[:32]
        name = _name(f"{table.path}/data/{folder}")
        spread = chunks.repartition(buckets, key)
        spread.write.bucketBy(buckets, key).sortBy(key).option("path", f"{table.path}/data/{folder}").saveAsTable(name)
        table.commit([folder], chunks.schema, base, "write", (), {"buckets": buckets, "key": key})
        return cls(spark, path)

    def read(self) -> DataFrame:
        """The rows, as a table whose buckets the planner knows."""
        name = _name(self.folder)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        location = json.dumps(self.folder)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
            f" CLUSTERED BY (`{self.facts['key']}`) SORTED BY (`{self.facts['key']}`) INTO {self.facts['buckets']} BUCKETS"
            f" LOCATION {location}"
        )
        return self.spark.table(name)


def _name(folder: str) -> str:
    return f"chunks_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
