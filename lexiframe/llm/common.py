"""Helpers of this subpackage: words, bounded joins, distributed prefix sums, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.session import checkpointed

WORD = "[^\\x20\\x09-\\x0D]+"  # a word: anything but ASCII white space
SMALL_ROWS = 1 << 19  # narrow rows that may be broadcast; beyond it Spark shuffles


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def checked_broadcast(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a written narrow table as broadcast side if it has at most ``rows`` rows.

    The size is counted before anything is sent; larger tables are joined by shuffling.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, label: str):
    """Rows of ``df`` plus ``before``: the sum of ``value`` over earlier rows of the group.

    ``order`` must name columns that order the rows of a group (rows equal in all of them are
    interchangeable).  The rows are range-sorted over all tasks, so a group may be of any size;
    each range has its own running sum and gets the totals of the group's earlier ranges.
    """
    ranges, step = "__range", "__step"
    ranged = checkpointed(
        df.repartitionByRange(*group, *order)
        .withColumn(ranges, F.spark_partition_id())
        .withColumn(step, F.monotonically_increasing_id()),
        label,
    )
    totals = ranged.groupBy(*group, ranges).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *(F.col(c).alias(f"__{c}") for c in group),
        F.col(ranges).alias("__r"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"),
    )
    same = F.col(ranges) == F.col("__r")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    running = (
        Window.partitionBy(ranges, *group)
        .orderBy(*order, step)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(starts, same)
        .withColumn(
            "before", F.col("__start") + F.coalesce(F.sum(value).over(running), F.lit(0))
        )
        .drop(ranges, step, "__r", "__start", *(f"__{c}" for c in group))
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component = smallest node.

    Contraction: every node hooks to its smallest neighbour, paths are shortened, edges are
    rewritten to the hooked nodes and those within one component go.  Stars of any size
    collapse in one round, as minima are aggregated before they are shuffled.
    """
    live = checkpointed(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        label,
    )
    labels = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = checkpointed(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("root")),
            label,
        )
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
        hook = checkpointed(hook.join(up, "root").select("node", F.col("top").alias("root")), label)
        if labels is None:
            labels = hook.select("node", F.col("root").alias("component"))
        else:
            step = hook.select(F.col("node").alias("component"), F.col("root").alias("top"))
            labels = labels.join(step, "component", "left").select(
                "node", F.coalesce("top", "component").alias("component")
            )
        labels = checkpointed(labels, label)
        low = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        high = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = checkpointed(
            live.join(low, "a").join(high, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            label,
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels
