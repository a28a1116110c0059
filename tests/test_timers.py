"""Conversation state that ends: ids, history, expiry by timer, late messages, scratch folders."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lexiframe.session import checkpointed, scratch_scope
from lexiframe.streaming import sessions, timers

T0 = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
HOUR = dt.timedelta(hours=1)
SCHEMA = "conv_id int, message_id int, ts timestamp, line string"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(sessions.PROVIDER, None)
    spark.conf.set(sessions.PROVIDER, sessions.ROCKSDB)
    yield
    if before is None:
        spark.conf.unset(sessions.PROVIDER)
    else:
        spark.conf.set(sessions.PROVIDER, before)


def run(spark, folder, batches, **options):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i:02d}")
    stream = (
        spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    )
    done = sessions.run_to_table(timers.conversation_stream(stream, **options), "test-timers")
    return done.collect()


def us(at):
    return int(at.timestamp()) * 1_000_000 + at.microsecond


def sid(key, at):
    return hashlib.sha256(f"{key}/{us(at)}".encode()).hexdigest()


def test_ids_history_and_expiry_over_batches(spark, tmp_path, rocksdb):
    first = [(1, n, T0 + n * HOUR, f"m{n}") for n in range(8)] + [(2, 50, T0, "a")]
    second = [(1, 8, T0 + 31 * HOUR, "m8"), (1, 9, T0 + 55 * HOUR + dt.timedelta(microseconds=1), "m9")]
    third = [(3, 60, T0 + 400 * HOUR, "z")]
    fourth = [(3, 61, T0 + 401 * HOUR, "zz")]
    got = run(spark, tmp_path, [first, second, third, fourth])
    messages = {r.message_id: r for r in got if r.kind == timers.MESSAGE}
    assert messages[0].context == "" and messages[7].context == "\n".join(f"m{i}" for i in range(1, 7))
    assert messages[8].session_id == sid(1, T0)  # exactly 24 h later: the same session
    assert messages[9].session_id == sid(1, T0 + 55 * HOUR + dt.timedelta(microseconds=1)) and messages[9].context == ""
    assert messages[61].context == "z" and messages[61].messages == 2
    ended = sorted((r.key, r.created_at, r.updated_at, r.messages) for r in got if r.kind == timers.EXPIRED)
    last = us(T0 + 55 * HOUR) + 1
    assert ended == [(1, us(T0), us(T0 + 31 * HOUR), 9), (1, last, last, 1), (2, us(T0), us(T0), 1)]
    assert not [r for r in got if r.kind == timers.LATE]


def test_late_messages_are_kept_apart_and_change_nothing(spark, tmp_path, rocksdb):
    batches = [
        [(1, 1, T0 + 100 * HOUR, "a"), (2, 2, T0 + 90 * HOUR, "b")],
        [(1, 3, T0 + 101 * HOUR, "c")],
        [(1, 4, T0 + 50 * HOUR, "late"), (1, 5, T0 + 100.5 * HOUR, "early"), (2, 6, T0 + 80 * HOUR, "late"), (9, 7, T0, "late")],
        [(1, 8, T0 + 124 * HOUR, "d")],
    ]
    got = run(spark, tmp_path, batches)
    assert sorted(r.message_id for r in got if r.kind == timers.LATE) == [4, 6, 7]
    messages = {r.message_id: r for r in got if r.kind == timers.MESSAGE}
    # 23 h after the newest message of the session, not 23.5 h after the one that came out of order
    assert messages[8].session_id == messages[1].session_id and messages[8].context == "a\nc\nearly"
    assert messages[5].updated_at == us(T0 + 101 * HOUR)
    assert set(messages) == {1, 2, 3, 5, 8}


def test_deletion_and_repeated_messages(spark, tmp_path, rocksdb):
    rows = [(1, 1, T0, "a"), (1, 1, T0, "a"), (1, 2, T0 + HOUR, "stop"), (1, 3, T0 + 2 * HOUR, "b"), (1, 4, T0 + 3 * HOUR, None)]
    got = run(spark, tmp_path, [rows], delete_line="stop", separator="|")
    shown = sorted((r.message_id, r.context) for r in got if r.kind == timers.MESSAGE)
    assert shown == [(1, ""), (1, "a"), (2, "a|a"), (3, ""), (4, "b")]


def test_state_is_empty_when_everything_has_expired():
    """The processor against a plain handle: no session, line or timer stays."""
    import pandas as pd

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        put = update

        def clear(self):
            self.held = None

    class Lines(Value):
        def get(self):
            return iter(self.held or [])

    class Handle:
        def __init__(self):
            self.timers, self.states = set(), []

        def getValueState(self, *a):
            self.states.append(Value())
            return self.states[-1]

        def getListState(self, *a):
            self.states.append(Lines())
            return self.states[-1]

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Expiry:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    handle, ttl = Handle(), 1000
    work = timers.Conversations(ttl, 10, 6, None, "\n")
    work.init(handle)
    frame = pd.DataFrame({"message_id": [1, 1, 2, 2], "at": [5, 5, 900, 900], "line": ["a", None, "b", None], "marker": [False, True] * 2})
    list(work.handleInputRows((7,), iter([frame.iloc[2:], frame.iloc[:2]]), None))
    assert handle.timers == {3} and all(s.exists() for s in handle.states)
    out = pd.concat(work.handleExpiredTimer((7,), None, Expiry(3)))
    assert out[["kind", "created_at", "updated_at", "messages"]].values.tolist() == [["expired", 5, 900, 2]]
    assert not any(s.exists() for s in handle.states)
    assert list(work.handleExpiredTimer((7,), None, Expiry(3))) == []  # once


def test_a_key_with_late_messages_alone_reads_and_writes_no_state():
    """Every use of state is a message to the JVM; a new session takes four, late ones none."""
    from pyspark.sql import Row

    class Handle:
        def __init__(self):
            self.calls, self.held = [], None

        def getValueState(self, *a):
            return self

        getListState = getValueState

        def get(self):
            self.calls.append("get")
            return self.held

        def put(self, lines):
            self.calls.append("put")

        def update(self, value):
            self.calls.append("update")
            self.held = value

        def registerTimer(self, at):
            self.calls.append("register")

    row, handle = Row("key", "message_id", "at", "marker", "line", "event_time"), Handle()
    work = timers.ConversationRows(1000, 10, 6, None, "\n")
    work.init(handle)
    both = [row(7, 1, 500, False, "a", None), row(7, 1, 500, True, None, None)]
    assert [(r.kind, r.message_id, r.context) for r in work.handleInputRows((7,), iter(both), None)] == [("message", 1, "")]
    assert handle.calls == ["get", "register", "update", "put"]
    handle.calls.clear()
    assert [(r.kind, r.message_id) for r in work.handleInputRows((7,), iter(both[1:]), None)] == [("late", 1)]
    assert handle.calls == []


def test_scopes_leave_no_folder(spark, tmp_path):
    with scratch_scope(spark) as path:
        checkpointed(spark.range(3), "a").count()
        with scratch_scope(spark) as inner:
            checkpointed(spark.range(3), "b").count()
        local = path.removeprefix("file://").removeprefix("file:")
        assert os.path.isdir(local) and not os.path.isdir(inner.removeprefix("file://").removeprefix("file:"))
    assert not os.path.isdir(local)
    with pytest.raises(RuntimeError), scratch_scope(spark) as path:
        checkpointed(spark.range(1), "c")
        raise RuntimeError
    assert not os.path.isdir(path.removeprefix("file://").removeprefix("file:"))


def test_micro_batches_leave_nothing(spark, tmp_path):
    """The number of scratch folders stays the same however many batches run."""
    from lexiframe.operators.chunks import hash_embed
    from lexiframe.session import shared_dir

    source = tmp_path / "in"
    for i in range(6):
        spark.createDataFrame([(f"{i}", f"helm {i}")], "query_id string, message string").coalesce(1).write.parquet(f"{source}/{i}")
    chunks = spark.createDataFrame([("a", "s", 1, None, "body", "helm 3")],
        "chunk_id string, source string, article_number long, paragraph_number long, chunk_type string, text string")
    chunks = checkpointed(hash_embed(chunks))
    stream = (
        spark.readStream.schema("query_id string, message string").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1).parquet(str(source))
    )
    scratch = os.path.join(shared_dir(spark).removeprefix("file://").removeprefix("file:"), "lexiframe")
    before = set(os.listdir(scratch))
    sessions.retrieve_stream(stream, chunks, str(tmp_path / "out")).awaitTermination()
    assert set(os.listdir(scratch)) == before
    assert spark.read.parquet(str(tmp_path / "out")).select(F.col("query_id")).distinct().count() == 6
