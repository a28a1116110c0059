"""Phrase collocations by dynamic itemset counting (operator 13).

The corpus is dealt into ``SHARDS`` shards, scanned in turn and again from the first one.  A phrase is
active from the step after both of its subphrases (without the last, without the first word) have
reached the threshold, whatever the other phrases of its length do, and is counted for one full cycle
from then on.  So phrases of all lengths are counted in the same scans, each over all shards.

While counting, a phrase is a 56-bit hash with its first step and length, which is all that is
shuffled.  A task learns what has reached the threshold from a table of fixed size, broadcast each step:
the slot of a phrase's hash holds the step from which its extensions are active.  Phrases that share a
slot or a hash can only make each other start early, though never before their own subphrases, or seem
more frequent; none is missed.  Running
counts of phrases still in their cycle stay in tables, one per step; those that end their cycle below
the threshold go.  The driver sees slot numbers only.  A last scan counts, as text, the phrases whose
slots hold something frequent; so every count that is returned is exact.

Texts are worked on in chunks of bounded size; a chunk returns one row per phrase.

Defined results: null texts are empty; null languages are ``und``; repeated rows count as often as they
occur; ids and other columns are ignored; an empty table gives no rows.  Phrases are compared by code
point order of their UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.words import mixed, texts_of
from lexiframe.session import checkpointed, scratch_path

LEAST = 100
LONGEST = 5
SHARDS = 2
TOP = 2000
PERCENT = 100
SLOTS = 1 << 23  # bytes of the broadcast table
CHUNK_BYTES = 1 << 24  # of the texts of a chunk; one longer text is a chunk of its own
CHUNK_LANGS = 64
HELD_ROWS = 1 << 19  # distinct phrases that a task of the last scan adds up
TASKS_PER_CORE = 2
CUT = b"\xff"  # stands for the end of a piece; no byte of a UTF-8 text
UNKNOWN = "und"

#: Lower case and one byte for all ends of pieces; what is left of white space is space and tab.
_PLAIN = bytes(CUT[0] if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACED = b" " + CUT + b" "

COUNTED = "key bigint, count bigint"  # key: 56 bits of the hash, five of the first step, three of the length
NAMED = "lang binary, phrase binary, words int, count bigint"
_HASH = np.uint64(~0xFF & 0xFFFFFFFFFFFFFFFF)


def plain_text(text: bytes | None) -> bytes:
    """Text in lower case with ``CUT`` as a word between pieces and after the last one."""
    return (text or b"").translate(_PLAIN).replace(CUT, _SPACED) + _SPACED


def longer_hash(shorter: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    return mixed(mixed(shorter ^ np.uint64(length)) ^ last)


def word_hashes(lang: bytes, words) -> np.ndarray:
    """Hashes of words of a language."""
    begin = lang + CUT
    return np.fromiter((xxhash.xxh3_64_intdigest(begin + w) for w in words), np.uint64, len(words))


class _Chunk:
    """Texts of one language as numbers of words.

    ``marks`` has, by slot, the first step of extensions, 0 while there is none.
    """

    def __init__(self, lang: bytes, marks: np.ndarray, longest: int):
        self.lang, self.marks, self.longest = lang, marks, longest
        self.shift = np.uint64(64 - (len(marks).bit_length() - 1))
        self.texts, self.size = [], 0

    def put(self, text: bytes | None) -> None:
        self.texts.append(plain_text(text))
        self.size += len(self.texts[-1])

    def _coded(self):
        """Distinct words, number of the word at every place, times of each word (0 for ends), hashes."""
        whole = b"".join(self.texts)
        self.texts, self.size = [], 0
        bounds = pa.py_buffer(np.array([0, len(whole)], np.int32))
        one = pa.Array.from_buffers(pa.string(), 1, [None, bounds, pa.py_buffer(whole)])
        coded = pc.ascii_split_whitespace(one).flatten().dictionary_encode()
        words, numbers = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
        filled = pc.and_(pc.not_equal(words, pa.scalar(CUT)), pc.greater(pc.binary_length(words), 0))
        times = np.bincount(numbers, minlength=len(words)) * filled.to_numpy(zero_copy_only=False)
        return words, numbers, times, word_hashes(self.lang, words.to_numpy(zero_copy_only=False))

    def _at(self, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Entries of the hashes' slots, which are their first bits."""
        return table[(hashes >> self.shift).astype(np.int64)] if len(table) > 1 else np.repeat(table, len(hashes))

    def step_counts(self, step: int, shards: int):
        """Batches of ``COUNTED`` rows of the phrases active in this step; forgets the texts."""
        _, numbers, times, own = self._coded()
        if step < shards:
            there = np.flatnonzero(times)
            yield _counted(own[there], 0, 1, times[there])
        mark = (self._at(self.marks, own) * (times > 0))[numbers]
        at = np.flatnonzero(mark)
        mark, hashes = mark[at], own[numbers[at]]
        for length in range(2, self.longest + 1):
            pair = np.flatnonzero(at[1:] - at[:-1] == 1)
            start = np.maximum(mark[pair], mark[pair + 1]).astype(np.int64)
            at = at[pair]
            longer = longer_hash(hashes[pair], own[numbers[at + length - 1]], length)
            counted = step < start + shards
            if counted.any():
                tag = (start[counted] * 8 + length).astype(np.uint64)
                yield _counted(*np.unique((longer[counted] & _HASH) | tag, return_counts=True))
            mark = self._at(self.marks, longer)
            on = mark > 0
            # a slot that another phrase marked does not let extensions start before the phrase itself
            at, mark, hashes = at[on], np.maximum(mark, start)[on], longer[on]

    def exact_counts(self, frequent: np.ndarray):
        """Batches of ``NAMED`` rows of the phrases whose slot is ``frequent``, and of all words (0 words)."""
        words, numbers, times, own = self._coded()
        yield self._rows(words, numbers[:0], numbers, 0, np.array([times.sum()]))
        there = np.flatnonzero(times * self._at(frequent, own))
        yield self._rows(words, there, np.arange(len(words)), 1, times[there])
        at = np.flatnonzero((self._at(self.marks, own) * (times > 0))[numbers])
        code, hashes = numbers[at].astype(np.int64), own[numbers[at]]
        for length in range(2, self.longest + 1):
            pair = np.flatnonzero(at[1:] - at[:-1] == 1)
            at, last = at[pair], numbers[at[pair] + length - 1]
            longer = longer_hash(hashes[pair], own[last], length)
            needed = np.flatnonzero(self._at(frequent, longer))  # what has extensions is frequent itself
            at, longer, last, code = at[needed], longer[needed], last[needed], code[pair][needed]
            _, first, code, many = np.unique((code << 32) | last, return_index=True, return_inverse=True, return_counts=True)
            if len(first):
                yield self._rows(words, at[first], numbers, length, many)
            on = self._at(self.marks, longer) > 0
            at, code, hashes = at[on], code[on], longer[on]

    def _rows(self, words, first, numbers, length, counts) -> pa.RecordBatch:
        """Rows for the phrases of ``length`` words that begin at the places ``first`` of ``numbers``."""
        parts = [words.take(pa.array(numbers[first + i])) for i in range(length)]
        space = pa.scalar(b" ", pa.binary())
        phrase = pc.binary_join_element_wise(*parts, space) if length else pa.array([b""] * len(counts), pa.binary())
        lang = pa.array([self.lang], pa.binary()).take(pa.array(np.zeros(len(counts), np.int64)))
        size = pa.array(np.full(len(counts), length, np.int32))
        return pa.RecordBatch.from_arrays([lang, phrase, size, pa.array(counts.astype(np.int64))], ["lang", "phrase", "words", "count"])


def _summed(batches):
    """Rows of ``NAMED`` added up within a task, as far as ``HELD_ROWS`` distinct ones."""
    held, rows = [], 0

    def merged() -> pa.Table:
        table = pa.Table.from_batches(held).group_by(["lang", "phrase", "words"]).aggregate([("count", "sum")])
        return table.rename_columns([c.removesuffix("_sum") for c in table.column_names]).select(["lang", "phrase", "words", "count"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 2 * HELD_ROWS:
            table = merged()
            held, rows = table.to_batches(), table.num_rows
            if rows >= HELD_ROWS:
                yield from held
                held, rows = [], 0
    if held:
        yield from merged().to_batches(max_chunksize=1 << 16)


def _counted(hashes: np.ndarray, *more) -> pa.RecordBatch:
    """Rows of hashes that are tagged already, or of hashes with a first step and length."""
    if len(more) > 1:
        start, length, counts = more
        hashes = (hashes & _HASH) | np.uint64(start * 8 + length)
    else:
        counts = more[0]
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "count"])


def _by_chunk(texts: DataFrame, marks, longest: int, count, schema: str, finish=iter) -> DataFrame:
    """Rows that ``count`` gives for the chunks of every task, through ``finish``."""

    def run(batches):
        yield from finish(chunk_rows(batches))

    def chunk_rows(batches):
        chunks: dict[bytes, _Chunk] = {}
        table = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            for lang, text in zip(texts_of(batch.column(0)), texts_of(batch.column(1)), strict=True):
                if lang not in chunks and len(chunks) >= CHUNK_LANGS:
                    full = list(chunks)
                elif sum(c.size for c in chunks.values()) >= 2 * CHUNK_BYTES:
                    full = list(chunks)
                elif lang in chunks and chunks[lang].size >= CHUNK_BYTES:
                    full = [lang]
                else:
                    full = []
                for done in full:
                    yield from count(chunks.pop(done))
                if lang not in chunks:
                    chunks[lang] = _Chunk(lang, table, longest)
                chunks[lang].put(text)
        for chunk in chunks.values():
            yield from count(chunk)

    return texts.select("lang", "text").mapInArrow(run, schema)


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """``lang, phrase, words, count`` of all phrases of up to ``longest`` words that occur ``least`` times.

    A row of 0 words per language has the number of all its word occurrences.
    """
    if slots & (slots - 1) or shards * longest > 30 or longest > 7:
        raise ValueError("slots must be a power of two, longest at most 7 and shards * longest at most 30")
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    path = scratch_path(spark, "shards")
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
    )
    texts.write.partitionBy("shard").parquet(path)
    texts = spark.read.schema("lang string, text string, shard int").parquet(path)
    words, start = F.col("key").bitwiseAND(F.lit(7)), F.shiftright("key", 3).bitwiseAND(F.lit(31))
    slot = F.shiftrightunsigned("key", 64 - (slots.bit_length() - 1)) if slots > 1 else F.lit(0)

    def slots_of(rows: DataFrame) -> np.ndarray:
        return rows.select(slot.cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()  # at most ``slots``

    marks, frequent = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8)
    running, step, last = None, 0, 0
    while step < shards or step < last + shards:
        sent = sc.broadcast(marks.tobytes())
        now = texts.where(F.col("shard") == step % shards)
        counts = _by_chunk(now, sent, longest, _Step(step, shards), COUNTED)
        if running is not None:
            counts = counts.unionByName(running)
        # a key has one row per chunk at most, so it is dealt out first and added up once
        totals = checkpointed(counts.repartition("key").groupBy("key").agg(F.sum("count").alias("count")), f"step{step}")
        sent.unpersist()
        reached = totals.where(F.col("count") >= least)
        found = slots_of(reached.where(words < longest))
        found = found[marks[found] == 0]
        marks[found] = step + 1
        last = step + 1 if len(found) else last
        frequent[slots_of(reached)] = 1
        running = totals.where(start > step + 1 - shards)
        step += 1
    sent = sc.broadcast(marks.tobytes())
    # a task returns a row per frequent phrase it meets, so there are as many tasks as keep the cores busy
    few = texts.coalesce(TASKS_PER_CORE * sc.defaultParallelism)
    exact = _by_chunk(few, sent, longest, _Exact(sc.broadcast(frequent.tobytes())), NAMED, _summed)
    exact = exact.repartition("lang", "phrase").groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count"))
    exact = exact.where((F.col("count") >= least) | (F.col("words") == 0))
    return checkpointed(exact.withColumns({c: F.col(c).cast("string") for c in ("lang", "phrase")}), "frequent")


class _Step:
    """Counts of a chunk in one step."""

    def __init__(self, step: int, shards: int):
        self.step, self.shards = step, shards

    def __call__(self, chunk: _Chunk):
        return chunk.step_counts(self.step, self.shards)


class _Exact:
    """Counts of a chunk's frequent phrases as text."""

    def __init__(self, frequent):
        self.frequent = frequent

    def __call__(self, chunk: _Chunk):
        return chunk.exact_counts(np.frombuffer(self.frequent.value, np.uint8))


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def cut_scores(found: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score, k`` of all phrases of two or more words: their lowest cut.

    The numbers are decimals of 38 digits, so products past 64 bits stay exact.
    """
    parts = found.where("words > 0").select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), "count")
    totals = found.where("words = 0").select(F.col("lang").alias("of_lang"), F.col("count").alias("n"))
    word = F.split("phrase", " ", -1)
    cuts = found.where("words > 1").select(
        "lang", "phrase", "words", F.col("count").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k")
    )
    cuts = cuts.withColumns(
        {
            "left": F.concat_ws(" ", F.slice(word, F.lit(1), F.col("k"))),
            "right": F.concat_ws(" ", F.slice(word, F.col("k") + 1, F.col("words"))),
        }
    )
    for side, name in (("left", "l"), ("right", "r")):
        same = (F.col("lang") == F.col("part_lang")) & (F.col(side) == F.col("part"))
        cuts = cuts.join(parts, same).withColumnRenamed("count", name).drop("part_lang", "part")
    cuts = cuts.join(totals, F.col("lang") == F.col("of_lang"))
    top = (_exact("a") * _exact("n")).cast("decimal(36,0)") * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumns({"top": top.cast("decimal(38,0)"), "bottom": (_exact("l") * _exact("r")).cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    low = F.min(F.struct("score", "k", "l", "r", "n")).alias("low")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(low).select("lang", "phrase", "words", "a", "low.*")


def without_parts(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Phrases of ``scored`` that no longer one contains which occurs at least ``percent`` % as often.

    It is enough to look one word further: what contains a phrase at some distance occurs no more
    often than what lies between, which is then in the table too.
    """
    word = F.split("phrase", " ", -1)
    inner = F.array(
        F.concat_ws(" ", F.slice(word, F.lit(1), F.col("words") - 1)),
        F.concat_ws(" ", F.slice(word, F.lit(2), F.col("words") - 1)),
    )
    longer = scored.where("words > 2").select(F.col("lang").alias("in_lang"), F.explode(inner).alias("in_phrase"), "a")
    longer = longer.groupBy("in_lang", "in_phrase").agg(F.max("a").alias("most"))
    same = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase"))
    rest = scored.join(longer, same, "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * percent))
    return rest.drop("in_lang", "in_phrase", "most")


def collocations(docs: DataFrame, top: int = TOP, **mining) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    scored = checkpointed(cut_scores(frequent_phrases(docs, **mining)), "scored")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (
        without_parts(scored)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
