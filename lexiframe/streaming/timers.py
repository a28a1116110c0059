"""Conversations as streaming state that ends: session ids, history, expiry by timer, late messages.

One stateful operator per key gives three kinds of rows:

* ``message``: a message with the id of its session and the history before it, as the prompt shows it;
* ``expired``: a session that was idle for longer than the TTL, once, when the watermark or a later
  message of the key shows it; its state is gone from then on;
* ``late``: a message behind the watermark, or one of a session that has ended; it changes no state.

Spark drops rows behind the watermark before a stateful operator sees them.  So each message travels
twice: as itself, and as a marker without event time, which is never dropped.  A marker whose message
is missing is a late message.

Needs the RocksDB state store provider (``sessions.PROVIDER`` set to ``sessions.ROCKSDB``).
"""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexiframe.functions import fixed
from lexiframe.operators.conversation import micros

MESSAGE, EXPIRED, LATE = "message", "expired", "late"
COLUMNS = ["kind", "key", "message_id", "session_id", "context", "created_at", "updated_at", "messages"]
_INPUT, _ROW = ("marker", "message_id", "at", "line"), Row(*COLUMNS)
SESSION = "id string, created bigint, updated bigint, messages bigint, timer bigint"
_HOUR = 3_600_000_000


def session_id(key, created: int) -> str:
    """Id of the session of ``key`` whose first message has this time, in microseconds."""
    return hashlib.sha256(f"{key}/{created}".encode()).hexdigest()


class Conversations(StatefulProcessor):
    """Session, last lines and expiry timer of a key, for rows in frames.

    Every read or write of state is a message to the JVM and back, so there are as few as can be.
    """

    def __init__(self, ttl: int, keep: int, shown: int, delete_line: str | None, separator: str):
        self.ttl, self.keep, self.shown = ttl, keep, shown
        self.delete_line, self.separator = delete_line, separator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)
        self.lines = handle.getListState("lines", "line string")

    def _held(self) -> dict | None:
        found = self.session.get()
        return None if found is None else dict(zip(("id", "created", "updated", "messages", "timer"), found))

    def _expired(self, key, held) -> tuple:
        return EXPIRED, key, None, held["id"], None, held["created"], held["updated"], held["messages"]

    def _handled(self, name, rows) -> list[tuple]:
        """``COLUMNS`` for rows (marker, message_id, at, line) of a key in any order; its state moves on."""
        arrived = [(int(at), message, line) for marker, message, at, line in rows if not marker]
        there = {(message, at) for at, message, _ in arrived}
        out = [
            (LATE, name, message, None, None, None, int(at), None)
            for marker, message, at, _ in rows
            if marker and (message, at) not in there
        ]
        if not arrived:  # late messages change no state, so it is not read
            return out
        arrived.sort(key=lambda x: (x[0], x[1] is None, 0 if x[1] is None else x[1]))
        held = self._held()
        lines = [x[0] for x in self.lines.get()] if held else []
        timer, changed = held["timer"] if held else None, False
        for at, message, line in arrived:
            if held and at > held["updated"] + self.ttl:
                out.append(self._expired(name, held))
                held, lines = None, []
            if held is None:
                held = {"id": session_id(name, at), "created": at, "updated": at, "messages": 0}
            elif at < held["created"] - self.ttl:  # of a session that is over
                out.append((LATE, name, message, None, None, None, at, None))
                continue
            changed = True
            held["messages"] += 1
            held["updated"] = max(held["updated"], at)
            shown = self.separator.join(lines[-self.shown :])
            out.append((MESSAGE, name, message, held["id"], shown, held["created"], held["updated"], held["messages"]))
            lines = [*lines, line][-self.keep :]
            if self.delete_line is not None and line == self.delete_line:
                held, lines = None, []
        if changed:
            self._store(held, lines, timer)
        return out

    def _store(self, held, lines, timer) -> None:
        due = -(-(held["updated"] + self.ttl) // 1000) + 1 if held else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if held is None:
            self.session.clear()
            self.lines.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.session.update((held["id"], held["created"], held["updated"], held["messages"], due))
        self.lines.put([(x,) for x in lines])

    def _ended(self, name, at: int) -> list[tuple]:
        held = self._held()
        if held is None or held["timer"] > at:
            return []
        self.session.clear()
        self.lines.clear()
        return [self._expired(name, held)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))  # frames of a key come in no order; a micro-batch is bounded by its trigger
        out = self._handled(key[0], list(zip(*(frame[c].tolist() for c in _INPUT), strict=True)))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._ended(key[0], expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield pd.DataFrame(out, columns=COLUMNS, dtype=object)

    def close(self) -> None:
        pass


class ConversationRows(Conversations):
    """The same for plain rows: most keys have a few messages a batch, less than a frame is worth."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # rows of a key come in no order; a micro-batch is bounded by its trigger
        for x in self._handled(key[0], [tuple(r[c] for c in _INPUT) for r in rows]):
            yield _ROW(*x)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for x in self._ended(key[0], expiredTimerInfo.getExpiryTimeInMs()):
            yield _ROW(*x)


def conversation_stream(
    messages: DataFrame,
    key: str = "conv_id",
    ttl_hours: int = fixed.SESSION_TTL_HOURS,
    lateness: str = "1 hour",
    delete_line: str | None = None,
    separator: str = "\n",
) -> DataFrame:
    """``COLUMNS`` for messages(key, message_id, ts, line); times are microseconds.

    ``line`` is what the history shows of a message (``conversation.history_line``).  Messages are
    taken in order of time, then id, within a micro-batch.
    """
    key_type, id_type = (messages.schema[c].dataType.simpleString() for c in (key, "message_id"))
    twice = messages.select(
        F.col(key).alias("key"), "message_id", "ts", "line", micros("ts").alias("at"),
        F.explode(F.array(F.lit(False), F.lit(True))).alias("marker"),
    )
    timed = twice.select("key", "message_id", "at", "marker", F.when(~F.col("marker"), F.col("line")).alias("line"),
                         F.when(~F.col("marker"), F.col("ts")).alias("event_time"))
    processor = ConversationRows(ttl_hours * _HOUR, fixed.MAX_CONTEXT_MESSAGES, fixed.HISTORY_MESSAGES, delete_line, separator)
    return (
        timed.withWatermark("event_time", lateness)
        .groupBy("key")
        .transformWithState(
            processor,
            outputStructType=(
                f"kind string, key {key_type}, message_id {id_type}, session_id string, context string,"
                " created_at bigint, updated_at bigint, messages bigint"
            ),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
