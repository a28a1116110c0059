"""Rolling context with TTL and deletion over several micro-batches; append-mode sessions."""

import datetime as dt

from lexiframe.streaming import sessions as ops

T0 = dt.datetime(2024, 1, 1, 12)
HOUR = dt.timedelta(hours=1)
SCHEMA = "conv_id int, message_id int, ts timestamp, kind string"


def stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        # file order is by modification time; one file per micro-batch
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i:02d}")
    return (
        spark.readStream.schema(SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1)
        .parquet(str(folder))
    )


def test_context_survives_batches_expires_and_is_deleted(spark, tmp_path):
    first = [(1, n, T0 + n * HOUR, f"m{n}") for n in range(8)]
    second = [
        (1, 8, T0 + 8 * HOUR, "m8"),
        (1, 9, T0 + 32 * HOUR, "m9"),  # exactly 24 h later: still there
        (1, 10, T0 + 56 * HOUR + dt.timedelta(microseconds=1), "m10"),  # expired
        (2, 20, T0, "a"),
    ]
    third = [(1, 11, T0 + 57 * HOUR, "delete"), (1, 12, T0 + 58 * HOUR, "m12"), (2, 21, T0 + HOUR, "b")]
    before = spark.conf.get(ops.PROVIDER, None)
    spark.conf.set(ops.PROVIDER, ops.ROCKSDB)
    try:
        source = stream(spark, tmp_path, [first, second, third])
        done = ops.run_to_table(ops.context_stream(source, delete_kind="delete"), "test-context")
        got = {r.message_id: r.context for r in done.collect()}
    finally:
        if before is None:
            spark.conf.unset(ops.PROVIDER)
        else:
            spark.conf.set(ops.PROVIDER, before)
    assert got[0] == "" and got[3] == "m0|m1|m2"
    assert got[7] == "m1|m2|m3|m4|m5|m6"
    assert got[8] == "m2|m3|m4|m5|m6|m7"
    assert got[9] == "m3|m4|m5|m6|m7|m8"
    assert got[10] == "" and got[11] == "m10" and got[12] == ""
    assert got[20] == "" and got[21] == "a"


def test_append_mode_emits_closed_sessions(spark, tmp_path):
    rows = [(1, 1, T0, "a"), (1, 2, T0 + HOUR, "b"), (1, 3, T0 + 60 * HOUR, "c")]
    later = [(2, 4, T0 + 200 * HOUR, "d")]
    last = [(3, 5, T0 + 201 * HOUR, "e")]
    source = stream(spark, tmp_path, [rows, later, last])
    done = ops.run_to_table(ops.session_stream(source), "test-sessions")
    assert sorted((r.conv_id, r.messages) for r in done.collect()) == [(1, 1), (1, 2)]


def test_messages_behind_the_watermark_are_dropped(spark, tmp_path):
    first = [(1, 1, T0 + 100 * HOUR, "a")]
    more = [(1, 3, T0 + 101 * HOUR, "c")]
    late = [(2, 2, T0, "b")]  # a batch's watermark filters the batch after the next one
    last = [(3, 4, T0 + 300 * HOUR, "d")]
    end = [(3, 5, T0 + 301 * HOUR, "e")]
    source = stream(spark, tmp_path, [first, more, late, last, end])
    done = ops.run_to_table(ops.session_stream(source), "test-late")
    assert [(r.conv_id, r.messages) for r in done.collect()] == [(1, 2)]


def test_a_table_in_part_files_streams_like_one_file(spark, tmp_path):
    rows = [(i, i % 3, f"m{i}") for i in range(40)]
    table = spark.createDataFrame(rows, "id int, conv_id int, text string")
    table.repartition(4).write.parquet(str(tmp_path / "parts" / "messages.parquet"))
    table.repartition(2).write.parquet(str(tmp_path / "parts" / "others.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "single").mkdir()
    (part,) = (tmp_path / "written").glob("*.parquet")
    part.rename(tmp_path / "single" / "messages.parquet")
    for folder in ("parts", "single"):
        stream = ops.message_stream(spark, str(tmp_path / folder), "messages", files_per_trigger=3)
        assert sorted(map(tuple, ops.run_to_table(stream, "test-parts").collect())) == rows
