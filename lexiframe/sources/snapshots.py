"""Versioned tables: immutable data folders, numbered manifests, readers pinned to a version.

    <path>/data/<unique>/       Parquet files of one write, never changed afterwards
    <path>/versions/<n>.json    schema and data folders of version n

A writer puts its rows into a new data folder and then commits a manifest: the file is written under
a temporary name and renamed to the next number, which fails if that number exists.  The rename is the
only switch, so a job lost at any point leaves the newest version as it was, and of two writers that
began with the same version one raises ``VersionConflict``.  A reader lists the folders of one version
and is not touched by later ones.  All files are reached through Hadoop's file systems, never by local
paths.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_DIGITS = 12


class VersionConflict(RuntimeError):
    """Another writer committed first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ files

    def _hadoop_path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _file_system(self):
        return self._hadoop_path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._file_system(), self._hadoop_path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _write_text(self, text: str, *parts: str) -> None:
        out = self._file_system().create(self._hadoop_path(*parts), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read_text(self, *parts: str) -> str:
        stream = self._file_system().open(self._hadoop_path(*parts))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _rename(self, old: tuple[str, ...], new: tuple[str, ...]) -> None:
        """Atomic rename that never replaces a file."""
        jvm = self.spark._jvm
        source, target = self._hadoop_path(*old), self._hadoop_path(*new)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._file_system().getUri(), self.spark._jsc.hadoopConfiguration()
        )
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(source, target, none)

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        names = (n.removesuffix(".json") for n in self._names("versions") if n.endswith(".json"))
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int:
        """Newest committed version; 0 where there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Manifest of a version, the newest one by default."""
        version = version or self.latest()
        if version not in self.versions():
            raise ValueError(f"{self.path} has no version {version}")
        return json.loads(self._read_text("versions", f"{version:0{_DIGITS}}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of one version; later commits do not change what this reads."""
        found = self.manifest(version)
        schema = T.StructType.fromJson(found["schema"])
        out = self.spark.createDataFrame([], schema) if not found["folders"] else None
        if found["partitions"]:
            for folder in found["folders"]:
                part = self.spark.read.schema(schema).parquet(f"{self.path}/data/{folder}").select(*schema.names)
                out = part if out is None else out.unionByName(part)
        elif found["folders"]:
            out = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in found["folders"]))
        return out

    # ------------------------------------------------------------ writing

    def write_data(self, df: DataFrame, partitions: tuple[str, ...] = ()) -> str:
        """New data folder with the rows of ``df``; no reader sees it before a commit."""
        folder = uuid.uuid4().hex
        df.write.partitionBy(*partitions).parquet(f"{self.path}/data/{folder}")
        return folder

    def commit(
        self,
        folders: list[str],
        schema: T.StructType,
        base: int,
        operation: str,
        partitions: tuple[str, ...] = (),
        facts: dict | None = None,
    ) -> int:
        """Make version ``base + 1`` of the given folders; raises if someone else did."""
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        found = {
            "version": base + 1,
            "operation": operation,
            "schema": nullable.jsonValue(),
            "folders": folders,
            "partitions": list(partitions),
            "facts": facts or {},
        }
        name = f"{base + 1:0{_DIGITS}}.json"
        waiting = ("versions", f"{name}.{uuid.uuid4().hex}.tmp")
        self._write_text(json.dumps(found), *waiting)
        try:
            self._rename(waiting, ("versions", name))
        except Exception as error:
            self._file_system().delete(self._hadoop_path(*waiting), False)
            if base + 1 in self.versions():
                raise VersionConflict(f"{self.path}: version {base + 1} was committed by another writer") from error
            raise
        return base + 1

    def replace(self, df: DataFrame, operation: str = "replace", base: int | None = None, **how) -> int:
        """Commit a version that holds the rows of ``df`` alone."""
        base = self.latest() if base is None else base
        folder = self.write_data(df, how.get("partitions", ()))
        return self.commit([folder], df.schema, base, operation, **how)

    def expire(self, keep: int = 2) -> list[int]:
        """Forget all but the newest ``keep`` versions; delete data folders no version or its facts name.

        Folders of writers at work would go too, so run it when there are none.
        """
        found, fs = self.versions(), self._file_system()
        old, held = found[: max(0, len(found) - keep)], set()
        for version in found[len(old) :]:
            found_in = self.manifest(version)
            held |= {*found_in["folders"], *(v for v in found_in["facts"].values() if isinstance(v, str))}
        for version in old:
            fs.delete(self._hadoop_path("versions", f"{version:0{_DIGITS}}.json"), False)
        for folder in self._names("data"):
            if folder not in held:
                fs.delete(self._hadoop_path("data", folder), True)
        return old
