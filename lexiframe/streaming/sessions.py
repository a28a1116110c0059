"""Streaming conversations: sessions, rolling context, deletion, retrieval."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexiframe.functions import fixed
from lexiframe.operators.conversation import micros
from lexiframe.session import scratch_path, scratch_scope

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def message_stream(
    spark: SparkSession, folder: str, name: str, ts: str | None = None, files_per_trigger: int = 64
) -> DataFrame:
    """Stream of a Parquet table, whether it is one file or a folder of part files.

    Watermarks need a timestamp, so a zone-less ``ts`` is read as UTC whatever the session
    zone.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a stream takes a single file only by a pattern, which the last letter is here
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}/{name}.parque[t]")
    )
    return stream if ts is None else stream.withColumn(ts, F.timestamp_micros(micros(ts)))


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything available into a Parquet table of the shared folder and read it."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def save(batch: DataFrame, number: int) -> None:
        # a repeated batch replaces its own folder; complete mode replaces the table
        target = f"{path}/batch={number if mode == 'append' else 0}"
        batch.write.mode("overwrite").parquet(target)

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}__state")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path).drop("batch")


def session_stream(
    messages: DataFrame,
    key: str = "conv_id",
    ts: str = "ts",
    ttl_hours: int = fixed.SESSION_TTL_HOURS,
    lateness: str = "1 hour",
) -> DataFrame:
    """Sessions of a message stream; messages later than the watermark are dropped."""
    return (
        messages.withWatermark(ts, lateness)
        .groupBy(key, F.session_window(ts, f"{ttl_hours} hours").alias("w"))
        .agg(
            F.min(ts).alias("created_at"),
            F.max(ts).alias("updated_at"),
            F.count("*").alias("messages"),
        )
        .drop("w")
    )


class RollingContext(StatefulProcessor):
    """Last messages of a key, forgotten after the TTL or on a delete request."""

    def __init__(self, ttl_hours: int, keep: int, shown: int, delete_kind: str | None):
        self.ttl = pd.Timedelta(hours=ttl_hours)
        self.keep, self.shown, self.delete_kind = keep, shown, delete_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "kind string")
        self.updated = handle.getValueState("updated", "ts timestamp")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        recent = [m[0] for m in self.messages.get()]
        stored = self.updated.get() if self.updated.exists() else None
        last = None if stored is None else pd.Timestamp(stored[0]).tz_localize(None)
        # frames of a key come in no order; a micro-batch is bounded by its trigger
        frame = pd.concat(list(rows)).sort_values(["ts", "message_id"], kind="stable")
        shown = []
        for at, kind in zip(frame["ts"], frame["kind"]):
            if last is not None and at > last + self.ttl:
                recent = []
            shown.append("|".join(recent[-self.shown :]))
            recent = [] if kind == self.delete_kind else [*recent, kind][-self.keep :]
            last = at
        yield pd.DataFrame({"key": key[0], "message_id": frame["message_id"], "context": shown})
        if recent:
            self.messages.put([(m,) for m in recent])
        else:
            self.messages.clear()
        if last is not None:
            self.updated.update((last.to_pydatetime(),))

    def close(self) -> None:
        pass


def context_stream(
    messages: DataFrame,
    key: str = "conv_id",
    delete_kind: str | None = None,
    ttl_hours: int = fixed.SESSION_TTL_HOURS,
) -> DataFrame:
    """(key, message_id, context) per message(key, message_id, ts, kind).

    Needs the RocksDB state store provider (``PROVIDER`` set to ``ROCKSDB``).
    """
    processor = RollingContext(
        ttl_hours, fixed.MAX_CONTEXT_MESSAGES, fixed.HISTORY_MESSAGES, delete_kind
    )
    key_type = messages.schema[key].dataType.simpleString()
    id_type = messages.schema["message_id"].dataType.simpleString()
    return (
        messages.select(key, "message_id", "ts", "kind")
        .groupBy(key)
        .transformWithStateInPandas(
            processor,
            outputStructType=f"key {key_type}, message_id {id_type}, context string",
            outputMode="Append",
            timeMode="None",
        )
    )


def retrieve_stream(questions: DataFrame, chunks: DataFrame, path: str, **options):
    """Start retrieving for a question stream; each micro-batch runs the batch plan.

    Results of a batch go to their own folder, so a repeated batch replaces itself; its intermediate
    tables are gone when it ends.  With ``search=index.searcher()`` a batch reads the cells its
    questions probe instead of all chunks.
    """
    from lexiframe.plans.answer import retrieve

    def answer(batch: DataFrame, number: int) -> None:
        with scratch_scope(batch.sparkSession, "batch"):
            retrieve(batch, chunks, **options).write.mode("overwrite").parquet(
                f"{path}/batch={number}"
            )

    return (
        questions.writeStream.option("checkpointLocation", f"{path}__state")
        .trigger(availableNow=True)
        .foreachBatch(answer)
        .start()
    )
