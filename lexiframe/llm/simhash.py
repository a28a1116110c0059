"""SimHash near-duplicates by multi-index hashing (operator 12).

A document's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it.
Documents are first reduced to distinct fingerprints, so copies meet in an aggregation only.  A
fingerprint is cut into two segments of 32 bits.  If two differ in at most two bits, either the first
segments differ in at most one bit or the second segments are equal.  Every fingerprint is in the table
under both segments, and looks up the ball of radius one around its first segment and its second segment
itself.  (Of a pair that differs in one bit of the first segment, only the one without the bit asks.)
Matches are verified by their complete distance.

Segments that more than ``HEAVY`` fingerprints share, as in a large family of near copies, are not
paired up: their members and those who ask for them enumerate the ball of radius one around the whole
fingerprint instead.  Two fingerprints differ in at most two bits exactly if these balls meet, and at
most 65 fingerprints have a given point in their balls, so this costs 65 rows a fingerprint however
large the family, and loses no link.

Defined results: null or empty texts have fingerprint zero, linked like any other; fewer words than a
shingle are one shingle; null ids take part and are ignored in minima; repeated ids are rows of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import checked_broadcast, components
from lexiframe.llm.words import texts_of, words_of
from lexiframe.session import checkpointed

WORDS = 3
SEED = 42
SEGMENT = 32  # bits; the method needs a half of the fingerprint for two differing bits
DISTANCE = 2
HEAVY = 64  # fingerprints with one segment
BLOCK = 1 << 14  # hashes whose bits are counted at once


def shingle_texts(words: list[bytes], width: int) -> list[bytes]:
    """Runs of ``width`` words, repeats included; fewer words are one run; no words give none."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprint(text: bytes | None, width: int = WORDS, seed: int = SEED) -> int:
    """64-bit fingerprint of a UTF-8 text, as a signed number."""
    runs = shingle_texts(words_of(text), width)
    ones, of = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(runs), BLOCK):
        some = runs[at : at + BLOCK]
        hashes = np.fromiter((of(s, seed) for s in some), "<u8", len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(runs), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t, width, seed) for t in texts_of(batch.column(1))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit((1 << SEGMENT) - 1))


def _table_keys(fp: Column) -> Column:
    """Both segments; even numbers stand for the first."""
    return F.array(_low(fp) * 2, F.shiftrightunsigned(fp, SEGMENT) * 2 + 1)


def _asked_keys(fp: Column) -> Column:
    """First segment with one more bit set."""
    bits = F.array(*(F.lit(1 << i).cast("bigint") for i in range(SEGMENT)))
    unset = F.filter(bits, lambda b: _low(fp).bitwiseAND(b) == 0)
    return F.transform(unset, lambda b: _low(fp).bitwiseOR(b) * 2)


def _ball(fp: Column) -> Column:
    """The fingerprint and all that differ from it in one bit."""
    signed = [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(64)]
    return F.concat(F.array(fp), F.transform(F.array(*(F.lit(b).cast("bigint") for b in signed)), lambda b: fp.bitwiseXOR(b)))


def linked_fingerprints(distinct: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``a, b``: links that connect all fingerprints of ``distinct(fp)`` at two or fewer differing bits."""
    fp = F.col("fp")
    table = distinct.select("fp", F.explode(_table_keys(fp)).alias("key"))
    crowded = checkpointed(
        table.groupBy("key").count().where(F.col("count") > heavy).select(F.col("key").alias("of")), "crowded"
    )
    asks = table.select("fp", "key", F.lit(False).alias("near")).union(
        distinct.select("fp", F.explode(_asked_keys(fp)).alias("key"), F.lit(True).alias("near"))
    )
    few = checked_broadcast(crowded)
    light = table.join(few, F.col("key") == F.col("of"), "left_anti").select(F.col("fp").alias("b"), "key")
    asking = asks.join(few, F.col("key") == F.col("of"), "left_anti").select(F.col("fp").alias("a"), "key", "near")
    links = (
        asking.join(light, "key")
        .where((F.col("near") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
        .select("a", "b")
    )
    if crowded.isEmpty():
        return links
    there = asks.join(few, F.col("key") == F.col("of"), "left_semi").select("fp").distinct()
    points = there.select("fp", F.explode(_ball(fp)).alias("point"))
    met = points.groupBy("point").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    pairs = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return links.union(pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))


def near_duplicates(docs: DataFrame, width: int = WORDS, seed: int = SEED, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; the id is the smallest one reachable over links."""
    rows = checkpointed(fingerprints(docs, width, seed), "fingerprints")
    distinct = checkpointed(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct"
    )
    links = checkpointed(linked_fingerprints(distinct.select("fp"), heavy), "links")
    parts = components(links).select(F.col("node").alias("fp"), "component")
    known = checkpointed(parts.join(distinct.drop("n"), "fp"), "parts")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = checkpointed(known.join(least, "component").select("fp", "component_id"), "linked")
    copied = distinct.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    groups = checkpointed(linked.union(copied), "groups")
    return rows.join(checked_broadcast(groups.withColumnRenamed("fp", "of")), F.col("fp") == F.col("of"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
