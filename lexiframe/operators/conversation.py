"""Conversation state over a message table: sessions, history windows, prompts.

A message row has conv_id, turn (orders the conversation), role and text.  Windows run
inside blocks of turns and carry the last few messages across blocks, so one very long
conversation is spread over many tasks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.functions.text import strip

TURNS_PER_BLOCK = 4096
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_HOUR = 3_600_000_000


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({ts} as timestamp_ntz))")


def message_id(*parts) -> Column:
    """Repeatable message id."""
    return F.sha2(F.concat_ws("/", *[F.col(p).cast("string") for p in parts]), 256)


def last_messages(
    messages: DataFrame,
    value: Column,
    n: int,
    name: str,
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """Add an array of ``value`` of the n messages before each message, oldest first."""
    block = F.floor(F.col("turn") / turns_per_block)
    rows = messages.withColumn("_block", block).withColumn("_v", value)
    in_block = Window.partitionBy("conv_id", "_block").orderBy("turn")
    recent = F.collect_list("_v").over(in_block.rowsBetween(-n, -1))
    latest = Window.partitionBy("conv_id", "_block").orderBy(F.desc("turn"))
    tails = (
        rows.select("conv_id", "_block", "turn", "_v")
        .withColumn("_n", F.row_number().over(latest))
        .where(F.col("_n") <= n)
        .groupBy("conv_id", "_block")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("turn", "_v"))), lambda m: m["_v"]
            ).alias("_tail")
        )
    )
    # every block holds at least one message, so n blocks hold the last n
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(-n, -1)
    carried = tails.select(
        "conv_id", "_block", F.flatten(F.collect_list("_tail").over(earlier)).alias("_carried")
    )
    both = F.concat("_carried", "_recent")
    start = F.greatest(F.size(both) - n + 1, F.lit(1))
    return (
        rows.withColumn("_recent", recent)
        .join(carried, ["conv_id", "_block"])
        .withColumn(name, F.slice(both, start, F.lit(n)))
        .drop("_block", "_v", "_recent", "_carried")
    )


def history_line(role: str = "role", text: str = "text") -> Column:
    """Labelled message, cut after 500 characters."""
    label = F.when(F.col(role) == "user", fixed.USER_LABEL).otherwise(fixed.ASSISTANT_LABEL)
    short = F.concat(F.substring(F.col(text), 1, fixed.HISTORY_CHARS), F.lit("..."))
    body = F.when(F.length(text) > fixed.HISTORY_CHARS, short).otherwise(F.col(text))
    return F.concat(label, F.lit(": "), body)


def history_window(messages: DataFrame, turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """Add ``history``: the last six earlier messages as labelled lines, '' when none.

    The session hands over its last ten messages; six of them are shown, so only six are
    gathered.
    """
    with_lines = last_messages(
        messages, history_line(), fixed.HISTORY_MESSAGES, "_lines", turns_per_block
    )
    return with_lines.withColumn("history", F.array_join("_lines", "\n")).drop("_lines")


def reference(article: Column, paragraph: Column) -> Column:
    """Citation of an article and, if it has one, its paragraph."""
    name = F.concat(
        F.lit(f"{fixed.ARTICLE_WORD} "), F.coalesce(article.cast("string"), F.lit("?"))
    )
    has_paragraph = paragraph.isNotNull() & (paragraph != 0)
    with_paragraph = F.concat(name, F.lit(" ayat ("), paragraph.cast("string"), F.lit(")"))
    return F.when(has_paragraph, with_paragraph).otherwise(name)


def format_context(results: DataFrame) -> DataFrame:
    """(query_id, context): numbered passages with citation and type, in rank order."""
    kind = F.when(
        F.col("chunk_type") == fixed.ELUCIDATION, fixed.ELUCIDATION_LABEL
    ).otherwise(fixed.BODY_LABEL)
    passage = F.concat(
        F.lit("["),
        F.col("rank").cast("string"),
        F.lit("] "),
        reference(F.col("article_number"), F.col("paragraph_number")),
        F.lit(" ("),
        kind,
        F.lit("):\n"),
        F.col("text"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", passage.alias("p"))))
    return results.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["p"]), "\n\n").alias("context"),
        F.count("*").alias("passages"),
    )


def prompt_table(
    questions: DataFrame, contexts: DataFrame, failed: DataFrame | None = None
) -> DataFrame:
    """Prompt per question(query_id, message, history), or the fixed answer without passages.

    Questions of ``failed(query_id)`` get no prompt and the fixed error answer.
    """
    joined = questions.join(contexts, "query_id", "left")
    broken = F.lit(False)
    if failed is not None:
        marked = failed.select("query_id", F.lit(True).alias("_failed"))
        joined = joined.join(marked, "query_id", "left")
        broken = F.coalesce("_failed", F.lit(False))
    found = (F.coalesce("passages", F.lit(0)) > 0) & ~broken
    history = F.when(
        F.coalesce("history", F.lit("")) != "",
        F.concat(F.lit(f"\n\n{fixed.PROMPT_HISTORY_TITLE}\n"), F.col("history"), F.lit("\n")),
    ).otherwise("")
    prompt = F.concat(
        F.lit(f"{fixed.PROMPT_CONTEXT_TITLE}\n"),
        F.coalesce("context", F.lit(fixed.NO_CONTEXT)),
        F.lit("\n"),
        history,
        F.lit(f"\n{fixed.PROMPT_QUESTION_TITLE}\n"),
        F.col("message"),
        F.lit(f"\n\n{fixed.PROMPT_CLOSING}"),
    )
    return joined.select(
        "query_id",
        F.when(found, prompt).alias("prompt"),
        F.when(broken, F.lit(fixed.PROCESSING_ERROR))
        .when(~found, F.lit(fixed.NO_RELEVANT_CHUNKS))
        .alias("answer"),
    )


def turn_log(turns: DataFrame) -> DataFrame:
    """Answer actually stored: a failed turn gets the fixed error text and no passages."""
    failed = F.coalesce(F.col("status") == "error", F.lit(False))
    none = F.array().cast(turns.schema["chunks"].dataType)
    return turns.withColumn(
        "response", F.when(failed, fixed.PROCESSING_ERROR).otherwise(F.col("response"))
    ).withColumn("chunks", F.when(failed, none).otherwise(F.col("chunks")))


def suppress_sources(turns: DataFrame) -> DataFrame:
    """Output view of a turn log: no passages beside one of the three fixed answers."""
    silent = F.col("response").isin(
        fixed.NOT_FOUND, fixed.NO_RELEVANT_CHUNKS, fixed.PROCESSING_ERROR
    )
    none = F.array().cast(turns.schema["chunks"].dataType)
    return turns.withColumn("chunks", F.when(silent, none).otherwise(F.col("chunks")))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Trim messages, drop blank ones, mark each request valid or not.

    Bounds: message 1..2000 characters, top_k 1..20, min_similarity 0..1; absent
    parameters take their defaults.
    """
    message = strip(F.col("message"))
    top_k = F.coalesce("top_k", F.lit(fixed.FINAL_TOP_K))
    similarity = F.coalesce("min_similarity", F.lit(fixed.MIN_SIMILARITY))
    checked = (
        requests.withColumn("message", message)
        .withColumn("top_k", top_k)
        .withColumn("min_similarity", similarity)
        .where(F.length("message") > 0)
    )
    return checked.withColumn(
        "is_valid",
        F.length("message").between(1, fixed.MAX_MESSAGE_CHARS)
        & F.col("top_k").between(1, fixed.MAX_TOP_K)
        & F.col("min_similarity").between(0.0, 1.0),
    )


def _activity(events: DataFrame, key: str, ts: str, ttl_hours: int) -> DataFrame:
    """Per key and TTL-wide time slot: first and last event and count.

    Two events of a slot are less than the TTL apart, so a slot never spans two sessions;
    this shrinks any key to one row per slot before rows of a key meet.
    """
    ttl = ttl_hours * _HOUR
    at = micros(ts)
    return (
        events.select(F.col(key).alias("key"), at.alias("at"))
        .groupBy("key", F.floor(F.col("at") / ttl).alias("slot"))
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    )


def _slot_sessions(events, key, ts, ttl_hours):
    slots = _activity(events, key, ts, ttl_hours)
    by_slot = Window.partitionBy("key").orderBy("slot")
    idle = F.col("lo") - F.lag("hi").over(by_slot)
    opens = F.coalesce(idle > ttl_hours * _HOUR, F.lit(True))
    return slots.withColumn("session_no", F.sum(opens.cast("int")).over(by_slot))


def sessionize(
    events: DataFrame,
    key: str = "conv_id",
    ts: str = "ts",
    ttl_hours: int = fixed.SESSION_TTL_HOURS,
) -> DataFrame:
    """One row per session: a key idle for more than the TTL starts a new one."""
    return (
        _slot_sessions(events, key, ts, ttl_hours)
        .groupBy("key", "session_no")
        .agg(
            F.min("lo").alias("created_at"),
            F.max("hi").alias("updated_at"),
            F.sum("n").alias("messages"),
        )
        .select(F.col("key").alias(key), "session_no", "created_at", "updated_at", "messages")
    )


def label_sessions(
    events: DataFrame,
    key: str = "conv_id",
    ts: str = "ts",
    ttl_hours: int = fixed.SESSION_TTL_HOURS,
) -> DataFrame:
    """Every event with its session number and a repeatable session id."""
    slots = _slot_sessions(events, key, ts, ttl_hours)
    first = Window.partitionBy("key", "session_no")
    named = slots.select(
        F.col("key").alias(key),
        F.col("slot").alias("_slot"),
        "session_no",
        F.sha2(F.concat_ws("/", "key", F.min("lo").over(first)), 256).alias("session_id"),
    )
    placed = events.withColumn("_slot", F.floor(micros(ts) / (ttl_hours * _HOUR)))
    return placed.join(named, [key, "_slot"]).drop("_slot")


def expired_sessions(
    events: DataFrame,
    asof: Column,
    key: str = "conv_id",
    ts: str = "ts",
    ttl_hours: int = fixed.SESSION_TTL_HOURS,
) -> DataFrame:
    """Keys whose last event is more than the TTL before ``asof`` (microseconds)."""
    last = events.groupBy(key).agg(F.max(micros(ts)).alias("updated_at"))
    return last.where(asof > F.col("updated_at") + ttl_hours * _HOUR)


def session_history(messages: DataFrame, at: str = "turn") -> DataFrame:
    """Messages in long form with position and the session's first and last ``at``.

    A session of any length stays one row per message.
    """
    bounds = messages.groupBy("conv_id").agg(
        F.min(at).alias("created_at"), F.max(at).alias("updated_at")
    )
    return messages.withColumn("message_id", message_id("conv_id", "turn")).join(
        bounds, "conv_id"
    )


def delete_sessions(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages of sessions nobody asked to delete."""
    return messages.join(requests.select("conv_id").distinct(), "conv_id", "left_anti")


def deletion_results(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request, whether the session existed."""
    known = messages.select("conv_id").distinct().withColumn("deleted", F.lit(True))
    return requests.join(known, "conv_id", "left").fillna(False, ["deleted"])
