"""Benchmark decontamination by latent semantic retrieval (operator 9).

Benchmark items and passages of documents are TF-IDF vectors over hashed words; document frequencies
cover all documents.  A randomised SVD gives their latent space: the matrix of the item pieces, which
weigh most, and the passages of a bounded sample of documents stays distributed, products with it are
Spark jobs, and only factors of fixed size reach the driver.  Pieces are searched in blocks no larger
than the rank, so the space holds them nearly whole.  Every window of every document is projected and
compared with every piece of the block; as both steps are linear, a table of bounded size has a word's
part in each comparison.  Parts below zero count as zero, so the words that a window shares with a
piece reach the sum of their parts whatever else stands there; a window is a candidate from the least
sum that enough words of the piece can have, so no window that passes the check is left out.
Candidates are checked on the words: the longest common subsequence must hold most of the piece, or
much of it and the words of its answer (its last sentence), which catches paraphrases.

Defined results: null or empty texts contain nothing; items of fewer than ``min_words`` words match
nothing (they would match clean documents); repeated items and repeated documents each have rows of
their own; null ids are kept; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import checked_broadcast
from lexiframe.llm.words import WordIds, texts_of, words_of
from lexiframe.session import checkpointed

BUCKETS = 1 << 14
RANK = 256
QR_ROWS = 1 << 11  # factored at once
PIECE = 64  # words of an item piece
STEP = 32  # words from window to window
WINDOW = 96  # PIECE + STEP: every run of PIECE words is whole in some window
FIT_DOCS = 1000  # documents sampled for the latent space
FIT_TASKS = 2  # their passages are a few thousand rows; each task sends a whole factor
BLOCK = RANK  # item pieces searched at once
PIECE_WEIGHT = 30.0  # of an item piece among the passages
MIN_WORDS = 8
LEAST_IDF = 0.05
ROUNDING = 1e-4  # of sums in single precision
LCS = 0.8
PARAPHRASE = 0.6
CHUNK = 1 << 14  # words projected at once

_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")


def answer_words(text: bytes) -> list[bytes]:
    """Words of the last sentence, or of the last quarter if that has fewer than three words."""
    words = words_of(text)
    last = words_of(_SENTENCE.split(text.strip())[-1])
    return last if 3 <= len(last) < len(words) else words[-max(3, len(words) // 4) :]


def common_subsequence(piece: list[bytes], window: list[bytes]) -> int:
    """Length of the longest common subsequence, one bit per word of the piece."""
    places: dict[bytes, int] = {}
    for i, word in enumerate(piece):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(piece)) - 1
    row = full
    for word in window:
        at = places.get(word)
        if at:
            hit = row & at
            row = ((row + hit) | (row - hit)) & full
    return len(piece) - row.bit_count()


def has_run(words: list[bytes], run: list[bytes]) -> bool:
    """Do the words of ``run`` stand in ``words`` one after the other?"""
    return b" " + b" ".join(run) + b" " in b" " + b" ".join(words) + b" "


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each word bucket is."""

    def run(batches):
        ids, rows, found = WordIds(buckets), 0, np.zeros(buckets, np.int64)
        number, there = ids.__getitem__, []
        for batch in batches:
            for text in texts_of(batch.column(0)):
                rows += 1
                if text:
                    there.extend(set(map(number, set(words_of(text)))))
                if len(there) >= 1 << 20:
                    found += np.bincount(there, minlength=buckets)
                    there.clear()
        found += np.bincount(np.array(there, np.int64), minlength=buckets)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(found[some], rows))], ["bucket", "n"]
        )

    counts = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n"))
    total, found = 0, np.zeros(buckets)
    for bucket, n in counts.collect():  # at most ``buckets`` rows
        if bucket < 0:
            total = n
        else:
            found[bucket] = n
    return total, found


def item_pieces(benchmark: DataFrame, min_words: int = MIN_WORDS, piece: int = PIECE) -> DataFrame:
    """``item_id, piece, text, answer``: items cut into runs of at most ``piece`` words."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = words_of(text)
                if len(words) < min_words:
                    continue
                count = -(-len(words) // piece)
                size = -(-len(words) // count)
                answer = answer_words(text.lower())
                for i in range(count):
                    part = words[i * size : (i + 1) * size]
                    end = answer if i == count - 1 else part[-max(3, len(part) // 4) :]
                    rows.append((item, i, b" ".join(part), b" ".join(end[-len(part) :])))
            names = ["item_id", "piece", "words", "answer"]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return benchmark.select(F.col("item_id").cast("bigint"), "text").mapInArrow(
        run, "item_id bigint, piece int, words binary, answer binary"
    )


def _rows_matrix(texts, idf: np.ndarray):
    """Sparse TF-IDF rows: buckets and weights."""
    ids = WordIds(len(idf))
    for words in texts:
        bucket, count = np.unique(ids.of(words), return_counts=True)
        yield bucket, (count * idf[bucket]).astype(np.float32)


def orthonormal(columns: np.ndarray, most: int = QR_ROWS) -> np.ndarray:
    """Orthonormal basis of the columns' span.

    Blocks of ``most`` rows are factored one after the other and so are their triangles, as numpy
    holds four copies in double precision of what it factors at once.
    """
    if len(columns) <= most:
        return np.linalg.qr(columns)[0]
    parts = [np.linalg.qr(columns[at : at + most]) for at in range(0, len(columns), most)]
    top = orthonormal(np.concatenate([r for _, r in parts]), max(most, 2 * columns.shape[1]))
    out, row, at = np.empty((len(columns), top.shape[1]), columns.dtype), 0, 0
    for q, r in parts:
        out[row : row + len(q)] = q @ top[at : at + len(r)]
        row, at = row + len(q), at + len(r)
    return out


def latent_space(rows: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Right singular vectors (buckets x rank) of the TF-IDF matrix of ``rows(row, words, weight)``.

    Range finder with one power step.  ``rows`` has a bounded number of rows; its products are
    computed where they lie, partial sums meet per column of the factor.
    """
    buckets = len(idf)

    def times(factor: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(factor)

        def run(batches):
            for batch in batches:
                texts = (w.split() for w in batch.column(1).to_pylist())
                out = [
                    (weights @ shared.value[bucket]) * scale
                    for (bucket, weights), scale in zip(_rows_matrix(texts, idf), batch.column(2).to_pylist(), strict=True)
                ]
                flat = [v.astype("<f4").tobytes() for v in out]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.binary())], ["row", "y"])

        got = rows.mapInArrow(run, "row bigint, y binary").orderBy("row").collect()
        shared.destroy()
        return np.array([np.frombuffer(r[1], "<f4") for r in got])

    def transposed_times(left: np.ndarray) -> np.ndarray:
        names = [r[0] for r in rows.select("row").orderBy("row").collect()]
        shared = rows.sparkSession.sparkContext.broadcast((dict(zip(names, range(len(names)), strict=True)), left))

        def partial(batches):
            place, factor = shared.value
            sums = np.zeros((buckets, factor.shape[1]), np.float32)
            for batch in batches:
                texts = (w.split() for w in batch.column(1).to_pylist())
                for row, scale, (bucket, weights) in zip(
                    batch.column(0).to_pylist(), batch.column(2).to_pylist(), _rows_matrix(texts, idf), strict=True
                ):
                    sums[bucket] += np.outer(weights * scale, factor[place[row]])
            for i in range(sums.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([sums[:, i].astype("<f4").tobytes()], pa.binary())], ["column", "z"]
                )

        def total(table: pa.Table) -> pa.Table:
            z = sum(np.frombuffer(v, "<f4").astype(np.float64) for v in table.column("z").to_pylist())
            return pa.table({"column": table.column("column")[:1], "z": pa.array([z.astype("<f4").tobytes()], pa.binary())})

        kind = "column bigint, z binary"
        got = rows.mapInArrow(partial, kind).groupBy("column").applyInArrow(total, kind).orderBy("column").collect()
        shared.destroy()
        return np.array([np.frombuffer(r[1], "<f4") for r in got]).T

    left = orthonormal(times(np.random.default_rng(seed).standard_normal((buckets, rank), np.float32)))
    left = orthonormal(times(orthonormal(transposed_times(left))))
    product = transposed_times(left)
    values, vectors = np.linalg.eigh((product.T @ product).astype(np.float64))
    keep = values > max(values.max(initial=0), 1e-12) * 1e-6
    return product @ (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)


def comparison_table(pieces, space: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Buckets x pieces: a word's part in the projection of its window onto a piece.

    The unit is the piece's own projection, so a window that holds a piece reaches about 1.  No part
    is below zero.
    """
    project = (space * idf[:, None]).astype(np.float32)
    ids = WordIds(len(idf))
    own = np.array([project[ids.of(words)].sum(0) for _, _, words, _ in pieces], np.float32)
    table = project @ (own / np.maximum((own**2).sum(1, keepdims=True), 1e-9)).T
    return np.maximum(table, 0, out=table)


def least_estimates(pieces, table: np.ndarray, share: float) -> np.ndarray:
    """Per piece the smallest estimate of a window that holds ``share`` of its words.

    That is the sum over the words with the smallest parts; other words of the window add nothing
    negative.
    """
    ids, out = WordIds(len(table)), np.zeros(len(pieces), np.float32)
    for number, (_, _, words, _) in enumerate(pieces):
        parts = np.sort(table[ids.of(words), number].astype(np.float64))
        out[number] = parts[: math.ceil(share * len(words))].sum() * (1 - ROUNDING)
    return out


class Searcher:
    """Finds item pieces in texts; built once per task."""

    def __init__(self, pieces, table: np.ndarray, parameters: dict):
        self.pieces, self.table, self.ids, self.p = pieces, table, WordIds(len(table)), parameters
        self.least = least_estimates(pieces, table, min(parameters["paraphrase"], parameters["lcs"]))

    def estimates(self, words: list[bytes]) -> np.ndarray:
        """Windows x pieces."""
        bucket, step = self.ids.of(words), self.p["step"]
        parts = []
        for at in range(0, len(bucket), CHUNK):  # CHUNK is a multiple of the step
            some = self.table[bucket[at : at + CHUNK]]
            parts.append(np.add.reduceat(some, np.arange(0, len(some), step), axis=0))
        blocks = parts[0] if len(parts) == 1 else np.concatenate(parts)
        span = self.p["window"] // step
        sums = blocks.copy()
        for i in range(1, min(span, len(blocks))):
            sums[:-i] += blocks[i:]
        return sums[: max(1, len(blocks) - span + 1)]

    def hits(self, text: bytes | None) -> list[tuple]:
        """``item, piece, start, common, words, answered`` of the best window per item."""
        words = words_of(text)
        if not words or not self.pieces:
            return []
        found = self.estimates(words)
        best: dict = {}
        last = -1
        for window, number in zip(*(x.tolist() for x in np.nonzero(found >= self.least)), strict=True):
            item, piece, own, answer = self.pieces[number]
            start = window * self.p["step"]
            if window != last:
                part = words[start : start + self.p["window"]]
                there, last = set(part), window
            if sum(word in there for word in own) < self.p["paraphrase"] * len(own):
                continue  # no subsequence is longer than that
            common = common_subsequence(own, part)
            if common < self.p["paraphrase"] * len(own):
                continue
            answered = has_run(part, answer)
            if common >= self.p["lcs"] * len(own) or answered:
                rank = (common / len(own), -piece, -start)
                if item not in best or rank > best[item][0]:
                    best[item] = (rank, (item, piece, start, common, len(own), answered))
        return [row for _, row in best.values()]


HIT_TYPE = "doc_id bigint, text_hash bigint, item_id bigint, piece int, start int, common int, words int, answered boolean"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = RANK,
    min_words: int = MIN_WORDS,
    lcs: float = LCS,
    paraphrase: float = PARAPHRASE,
    block: int = BLOCK,
) -> DataFrame:
    """A row per document row and benchmark item found in it: where, and how much of it."""
    spark = docs.sparkSession
    pieces = checkpointed(
        item_pieces(benchmark, min_words).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    count = pieces.count()
    if not count:
        return spark.createDataFrame([], HIT_TYPE)
    rows, found = document_frequencies(docs)
    idf = np.maximum(np.log((rows + 1) / (found + 1)), LEAST_IDF)
    sample = checkpointed(
        docs.select("doc_id").where("doc_id is not null").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS).withColumnRenamed("doc_id", "__id"),
        "sample",
    )
    # written before they are split, as filters on the words would be pushed to all texts
    sampled = checkpointed(
        docs.where("text is not null").select("doc_id", "text")
        .join(checked_broadcast(sample), F.col("doc_id") == F.col("__id"), "left_semi"),
        "sampled",
    )
    passages = checkpointed(
        sampled.select("doc_id", F.split(F.trim("text"), r"[\x20\x09-\x0D]+").alias("w"))
        .select("doc_id", "w", F.explode(F.expr(f"sequence(1, size(w), {WINDOW})")).alias("at"))
        .select(F.lower(F.array_join(F.expr(f"slice(w, at, {WINDOW})"), " ")).cast("binary").alias("words"))
        .withColumn("row", F.monotonically_increasing_id() - F.lit(1 << 62)),
        "passages",
    )
    parameters = {"step": STEP, "window": WINDOW, "lcs": lcs, "paraphrase": paraphrase}
    out = None
    for number in range(blocks := math.ceil(count / block)):
        mine = pieces.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number) if blocks > 1 else pieces
        matrix = checkpointed(
            mine.select("row", "words", F.lit(PIECE_WEIGHT).alias("weight"))
            .union(passages.select("row", "words", F.lit(1.0).alias("weight")))
            .repartition(FIT_TASKS).sortWithinPartitions("row"),
            "matrix",
        )
        space = latent_space(matrix, idf, rank)
        known = [
            (r["item_id"], r["piece"], bytes(r["words"]).split(), bytes(r["answer"]).split())
            for r in mine.orderBy("row").collect()
        ]
        shared = spark.sparkContext.broadcast((known, comparison_table(known, space, idf)))
        del space

        def run(batches, shared=shared):
            searcher = Searcher(*shared.value, parameters)
            fields = pa.schema(
                [(n, pa.int64()) for n in ("doc_id", "text_hash", "item_id")]
                + [(n, pa.int32()) for n in ("piece", "start", "common", "words")]
                + [("answered", pa.bool_())]
            )
            ids = lambda batch: (batch.column(n).to_pylist() for n in (0, 1))
            for batch in batches:
                rows = [
                    (doc, own, *hit)
                    for doc, own, text in zip(*ids(batch), texts_of(batch.column(2)), strict=True)
                    for hit in searcher.hits(text)
                ]
                columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields
                )

        text = F.col("text").cast("string")
        hits = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text), text.alias("text")).mapInArrow(run, HIT_TYPE)
        out = hits if out is None else out.union(hits)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, keep_null_ids: bool = True, **parameters) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item was found.

    Rows without an id stay, unless ``keep_null_ids`` is off.  Rows go by id and text: other texts under
    the same id stay.  Other columns are kept, whatever their names.
    """
    leaks = checkpointed(find_leaks(docs, benchmark, **parameters), "leaks")
    leaks = leaks.where("doc_id is not null") if keep_null_ids else leaks
    drop = checkpointed(leaks.select("doc_id", "text_hash").distinct(), "drop")
    same_id = F.col("docs.doc_id").cast("bigint").eqNullSafe(F.col("leaks.doc_id"))
    same = same_id & (F.xxhash64(F.col("docs.text").cast("string")) == F.col("leaks.text_hash"))
    return docs.alias("docs").join(checked_broadcast(drop).alias("leaks"), same, "left_anti")
