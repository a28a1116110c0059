"""Dictionary join: which entries of a pattern table occur inside the text of each row.

All patterns are found in one pass over a text by a multi-pattern automaton, whose cost does not
depend on their number.  A dictionary below a checked size is sent to every task and the texts stay
where they are.  A larger one is cut into parts by hash; every text meets every part, in tasks of
bounded size, and the findings of a row come back by the row's number.  Results belong to rows, never
to ids, so they are the same at every size: repeated and null ids, repeated entries and blank patterns
need no special care.

Defined results: a null text or pattern matches nothing, the empty pattern is in every text; entries
are ordered by their columns from left to right, nulls first, and repeated ones fire as often as they
occur; an empty dictionary fires nothing.
"""

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexiframe.operators.topk_join import CELL_BYTES, rows_within
from lexiframe.session import checkpointed

MAX_BYTES = 32 << 20  # of a dictionary's patterns that one task holds
ENTRY_BYTES = 64  # counted for each entry besides its pattern


class PatternMatcher:
    """Numbers of the patterns inside a text, ascending."""

    def __init__(self, patterns):
        self.automaton, self.always, self.groups = ahocorasick.Automaton(), [], {}
        for number, pattern in enumerate(patterns):
            if pattern == "":
                self.always.append(number)
            elif pattern is not None:
                self.groups.setdefault(pattern, []).append(number)
        for pattern, numbers in self.groups.items():
            self.automaton.add_word(pattern, numbers)
        if self.groups:
            self.automaton.make_automaton()

    def numbers(self, text) -> list[int]:
        if text is None:
            return []
        found = {id(n): n for _, n in self.automaton.iter(text)} if self.groups else {}
        return sorted(x for n in (*found.values(), self.always) for x in n)


def fired_entries(
    rows: DataFrame,
    text: str,
    entries: DataFrame,
    pattern: str,
    name: str = "fired",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``rows`` plus ``name``: the entries, as structs in order, whose pattern occurs in the text."""
    columns = entries.columns
    size = F.sum(F.coalesce(F.octet_length(pattern), F.lit(0)) + ENTRY_BYTES).alias("bytes")
    entries = checkpointed(entries, "entries")
    total = entries.agg(size).first().bytes or 0
    struct = T.StructType([T.StructField(f.name, f.dataType, True) for f in entries.schema.fields])
    if total <= max_bytes:
        return _fired_here(rows, text, entries.orderBy(*columns), pattern, name, struct)
    parts = -(-total // max_bytes) + 1
    return _fired_by_parts(rows, text, entries, pattern, name, struct, parts)


def _fired_here(rows, text, entries, pattern, name, struct):
    table = entries.toArrow().combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast(table)
    kind = pa.list_(to_arrow_type(struct))
    state = {}  # per worker: the automaton is built once

    @F.arrow_udf(T.ArrayType(struct))
    def fired(texts: pa.Array) -> pa.Array:
        if not state:
            held = shared.value
            arrays = [held.column(f.name).cast(to_arrow_type(f.dataType)) for f in struct.fields]
            arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            state["entries"] = pa.StructArray.from_arrays(arrays, [f.name for f in struct.fields])
            state["matcher"] = PatternMatcher(held.column(pattern).to_pylist())
        found = [state["matcher"].numbers(t) for t in texts.to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        flat = pa.array([n for f in found for n in f], pa.int64())
        return pa.ListArray.from_arrays(pa.array(offsets), state["entries"].take(flat)).cast(kind)

    return rows.withColumn(name, fired.asNondeterministic()(F.col(text)))


def _fired_by_parts(rows, text, entries, pattern, name, struct, parts):
    """Every text meets every part of the dictionary; groups hold one part and a bounded block of texts."""
    clash = {"_row", "_part", "_block"} & set(rows.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    numbered = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    texts = numbered.select("_row", F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    blocks = max(1, -(-numbered.count() // rows_within(texts, CELL_BYTES)))
    texts = texts.select(
        "_row",
        "_text",
        F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"),
    )
    spread = F.pmod(F.xxhash64(*entries.columns), F.lit(parts)).cast("int")
    held = entries.withColumn("_part", spread).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out = T.StructType([T.StructField("_row", T.LongType()), *struct.fields])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        matcher = PatternMatcher(right.column(pattern).to_pylist())
        found = [matcher.numbers(t) for t in left.column("_text").to_pylist()]
        owner = np.repeat(np.arange(left.num_rows), [len(f) for f in found])
        flat = pa.array([n for f in found for n in f], pa.int64())
        columns = [left.column("_row").take(pa.array(owner))]
        columns += [right.column(f.name).take(flat).cast(to_arrow_type(f.dataType)) for f in struct.fields]
        return pa.table(columns, schema=schema)

    keys = ["_part", "_block"]
    found = texts.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(match, out)
    fired = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(*struct.names))).alias(name))
    empty = F.array().cast(T.ArrayType(struct))
    return numbered.join(fired, "_row", "left").withColumn(name, F.coalesce(name, empty)).drop("_row")
