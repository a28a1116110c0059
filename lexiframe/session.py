"""Session helpers."""

import contextlib
import contextvars
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, name: str = "lexiframe") -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder.

    A temporary folder is set only where the session names none and runs in local mode.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexiframe-"))
    return os.path.dirname(sc.getCheckpointDir())


_SCOPE: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch_scope", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """New unique path below the shared folder, or below the folder of the scope at hand."""
    folder = _SCOPE.get() or f"{shared_dir(spark).rstrip('/')}/lexiframe"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, label: str = "scope"):
    """Intermediate tables written inside go when the block ends, however it ends.

    What is read from them has to be written elsewhere before.
    """
    path = scratch_path(spark, label)
    token = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df, label: str = "table"):
    """Cut lineage: write the rows below the shared folder once and read them back.

    Unlike an RDD checkpoint this computes the rows a single time, keeps column pruning and
    gives the planner a size.  The folder's own retention removes the files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
