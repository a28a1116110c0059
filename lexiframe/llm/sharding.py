"""Sharding along a Hilbert curve (operator 4).

Several metadata dimensions are quantised to a few bits each, every row gets the index of its cell
on the Hilbert curve through all of them, rows are range-sorted by that index and the sorted run is
cut into shards.  Neighbours on the curve are near in every dimension, so each shard covers a small
box and a reader can skip shards by their ranges of all dimensions at once.

The law is ``rows``: shard counts are at most one apart.  Quantisation needs no pass over the data:
numbers go by half octaves of their value, text by its hash (readers look for
equal values of text), so a row's cell depends on the row alone.

Defined results: null text has 16 bytes and the checksum of the empty text; null metadata has cell
0; equal rows take adjacent slots in any order; an empty table gives no rows; other columns are
ignored by ``shard`` and kept by ``write_shards``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.common import prefix_sums
from lexiframe.session import checkpointed

SHARDS = 40
BITS = 4


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of the rows of ``cells`` (rows x dimensions).

    The usual two steps: undo the curve's rotations from the top bit down, then Gray-code and
    interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for d in range(dims):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x ^= flips
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


def number_cell(value: Column, bits: int = BITS, low: int = 7) -> Column:
    """Logarithmic cell of a number: half octaves from ``2 ** low`` on; null and less are 0."""
    steps = F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double")) * 2) - 2 * low
    top = (1 << bits) - 1
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(top), steps)), F.lit(0)).cast("int")


def text_cell(value: Column, bits: int = BITS) -> Column:
    """Cell of a text by its hash; null is 0."""
    return F.coalesce(F.crc32(value.cast("string").cast("binary")) % (1 << bits), F.lit(0)).cast("int")


def hilbert(cells: list[Column], bits: int = BITS) -> Column:
    """Curve index of a row from the cells of its dimensions."""

    @F.pandas_udf("bigint")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], 1), bits))

    return index(*cells)


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve`` for every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(text) + 16).cast("bigint")
    rows = checkpointed(
        docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), "source", "lang"),
        "meta",
    )
    cells = [text_cell(F.col("source"), bits), text_cell(F.col("lang"), bits), number_cell(F.col("size"), bits)]
    placed = rows.select(
        "doc_id", "size", "text_crc32", hilbert(cells, bits).alias("curve"),
        F.lit(0).alias("all"), F.lit(1).alias("one"),
    )
    order = ["curve", "text_crc32", "doc_id", "size"]
    ranked = prefix_sums(placed, ["all"], order, "one", "curve")
    total = rows.count()
    # integer arithmetic: the first rank of shard s is ceil(s * total / shards)
    number = F.expr(f"(before * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"((before * {shards}L) div {max(total, 1)}L * {total}L + {shards - 1}L) div {shards}L")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        number.cast("int").alias("shard"),
        (F.col("before") - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(docs: DataFrame, path: str, **parameters) -> DataFrame:
    """Write one folder per shard, rows in curve order; returns the manifest used for pruning.

    The manifest has a row per shard with counts, bytes and the range of every dimension.  Rows
    are matched to their places by id and checksum; rows equal in both take their places in turn.
    A column ``shard`` of ``docs`` is replaced.
    """
    placed = checkpointed(shard(docs, **parameters), "placed")
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy("shard", "slot"))
    placed = placed.withColumn("turn", turn).alias("place")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.drop("shard")
    rows = rows.select(F.struct(*rows.columns).alias("row"), F.col("doc_id").alias("id"), F.crc32(text).alias("crc"))
    turn = F.row_number().over(Window.partitionBy("id", "crc").orderBy(F.xxhash64("row")))
    same = F.col("id").eqNullSafe(F.col("place.doc_id")) & (F.col("crc") == F.col("place.text_crc32"))
    rows = rows.withColumn("turn", turn).alias("rows").join(placed, same & (F.col("rows.turn") == F.col("place.turn")))
    (
        rows.select("row", "place.shard", "place.slot")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select("row.*", "shard")
        .write.partitionBy("shard")
        .parquet(path)
    )
    written = docs.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length("text")).alias("bytes"),
        *(f(c).alias(f"{name}_{c}") for c in ("source", "lang", "n_chars") for name, f in (("min", F.min), ("max", F.max))),
    )


def shards_to_read(manifest: DataFrame, **wanted) -> DataFrame:
    """Shards whose ranges can hold rows with all the given values."""
    for name, value in wanted.items():
        manifest = manifest.where(
            (F.col(f"min_{name}") <= F.lit(value)) & (F.col(f"max_{name}") >= F.lit(value))
        )
    return manifest.select("shard")
