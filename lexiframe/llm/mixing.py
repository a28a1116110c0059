"""Mixing sources to target weights (operator 10).

Every source gets a share of all words in proportion to its weight, at most ``max_epochs`` times
its own words; what a full source leaves is shared again among the others.  Within a source the
documents are put in the order of a hash key and taken until the budget is used up: whole epochs
first, then the documents up to the exact word at which the rest of the budget ends.

Only DataFrame functions are used.  One text scan gives narrow rows (id, source, size); everything
else works on those.  Sources are aggregated before they are ranked, and documents are range-sorted
over all tasks, so a source may hold any part of the rows.

Defined results: null text has size 0 and nothing is taken of it; the null source comes last; a
repeated row is taken as a document of its own, ordered beside its equal; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import checked_broadcast, prefix_sums, word_count
from lexiframe.session import checkpointed

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``(source, source_size)`` plus ``target`` and ``weight``.

    Weights go round in the order of the sources.  A source is full when its weight's share of
    what the full ones leave is above its cap; the sets of full sources only grow, so a few
    aggregations settle it (each is one row, whatever the number of sources).
    """
    ranked = prefix_sums(
        sources.withColumn("one", F.lit(1))
        .withColumn("nothing", F.col("source").isNull())
        .withColumn("all", F.lit(0)),
        ["all"],
        ["nothing", "source"],
        "one",
        "sources",
    )
    cycle = F.array(*(F.lit(w) for w in weights))
    weighed = checkpointed(
        ranked.select(
            "source",
            "source_size",
            F.element_at(cycle, (F.col("before") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * max_epochs).alias("cap"),
        ),
        "weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    left, open_weight = total, None
    # a literal is as narrow as its value, so products of sizes and weights are taken as decimals
    exact = "decimal(19,0)"
    while True:
        full = F.lit(False) if open_weight is None else (
            F.col("cap").cast(exact) * F.lit(open_weight).cast(exact)
            <= F.lit(left).cast(exact) * F.col("weight").cast(exact)
        )
        row = weighed.agg(
            F.sum(F.when(full, F.col("cap"))).alias("capped"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        state = (total - (row["capped"] or 0), row["open"] or 0)
        if state == (left, open_weight) or not state[1]:
            break
        left, open_weight = state
    share = (F.lit(float(left)) * F.col("weight")) / F.lit(float(open_weight or 1))
    return weighed.select(
        "source", "source_size", "weight", F.least(F.col("cap").cast("double"), share).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, text_hash`` for every row of ``docs``."""
    rows = checkpointed(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        ),
        "sizes",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(sources, weights, max_epochs), "targets")
    keyed = rows.withColumn(
        "key", F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    )
    placed = prefix_sums(keyed, ["source"], ["key", "doc_id", "size", "text_hash"], "size", "mixed")
    goal = checked_broadcast(targets.withColumnRenamed("source", "to"))
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    return (
        placed.join(goal, F.col("source").eqNullSafe(F.col("to")))
        .withColumn("epochs", epochs)
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size") - F.col("before"))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", "rest")))
            .cast("bigint")
            .alias("taken"),
            "text_hash",
        )
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: rows of ``docs`` repeated for every epoch that takes from them.

    A document at which a budget ends is kept whole, so a source may exceed its target by less
    than one document.  Documents of which nothing is taken go, those without words included.
    Rows are matched by id, source and text.  Of rows equal in all three one is repeated as often as
    they are taken together.  Other columns are kept, whatever their names.
    """
    plan = (
        mix(docs, **parameters)
        .groupBy("doc_id", "source", "text_hash")
        .agg(
            F.sum(F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)).cast("int").alias("copies"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    plan = checkpointed(plan.where("copies > 0"), "copies")
    taken = _repeated(docs, plan.where("rows = 1"))
    equal = checkpointed(plan.where("rows > 1"), "equal")
    if equal.isEmpty():
        return taken
    some = docs.alias("docs").join(checked_broadcast(equal).alias("plan"), _same_row(), "left_semi")
    return taken.unionByName(_repeated(some.dropDuplicates(["doc_id", "source", "text"]), equal))


def _same_row():
    return (
        F.col("docs.doc_id").eqNullSafe(F.col("plan.doc_id"))
        & F.col("docs.source").cast("string").eqNullSafe(F.col("plan.source"))
        & (F.xxhash64(F.col("docs.text").cast("string")) == F.col("plan.text_hash"))
    )


def _repeated(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as ``plan`` says."""
    rows = docs.alias("docs").join(checked_broadcast(plan).alias("plan"), _same_row())
    copies = F.explode(F.sequence(F.lit(1), F.col("plan.copies")))
    return rows.select(F.struct("docs.*").alias("row"), copies.alias("copy")).select("row.*")
