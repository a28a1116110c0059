"""Quality classifier: naive Bayes support vectors (operator 2).

Features are indicators of n-grams, hashed into buckets: words and word pairs as written, and runs of
one to three word shapes (case, digits, signs and whether a word repeats the one before).  Each
indicator is scaled by the log-count ratio of its bucket between the classes, vectors get unit length,
and a linear hinge-loss model is fitted by dual coordinate descent.  A logistic curve fitted on rows
kept out of the descent turns margins into scores.

The model is fitted on at most ``per_class`` labelled rows of each class, those of smallest hash; the
counts behind the ratios come from the same rows, the prior from all labels.  Scoring reads every text
once where it lies.

Defined results: null text is the empty text, whose score comes from the bias alone; documents with
contradicting labels teach nothing, repeated labels count once; without labels all scores are 0.5, with
one class only they are its label; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import crc_mod
from lexiframe.llm.words import texts_of
from lexiframe.session import checkpointed

BITS = 18
PER_CLASS = 4000
EPOCHS = 12
COST = 1.0
SMOOTH = 1.0
THRESHOLD = 0.7

_SHAPE = ((regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"\p{Ll}+"), "a"), (regex.compile(r"\p{N}+"), "0"), (regex.compile(r"([^Aa0])\1+"), r"\1"))


def word_shape(word: bytes) -> str:
    """Letters by case, digits and signs, runs as one."""
    text = word.decode("utf-8", "replace")
    for pattern, to in _SHAPE:
        text = pattern.sub(to, text)
    return text


class _Numbers(dict):
    """Number of a word; a word not met before gets the next one."""

    def __init__(self, features):
        super().__init__()
        self.features = features

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.features.add(word, number)
        return number


class Features:
    """Buckets of the n-grams of a text; words are looked up once per task."""

    def __init__(self, bits: int = BITS, most: int = 1 << 19):
        self.mask, self.most = (1 << bits) - 1, most
        self._forget()

    def _forget(self):
        self.ids, self.table = _Numbers(self), np.zeros((2, 1 << 14), np.uint64)

    def add(self, word: bytes, number: int) -> None:
        if number == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
        self.table[0, number] = xxhash.xxh3_64_intdigest(word)
        self.table[1, number] = xxhash.xxh3_64_intdigest(word_shape(word).encode())

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        if not words:
            return np.empty(0, np.int32)
        if len(self.ids) > self.most:
            self._forget()
        number = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        word, shape = self.table[:, number]
        again = np.zeros(len(words), np.uint64)
        again[1:] = number[1:] == number[:-1]
        shape = _mix(shape + again * np.uint64(77))
        grams = [word, _mix(word[:-1] * np.uint64(31) + word[1:]), shape + np.uint64(1)]
        grams += [_mix(shape[:-1] * np.uint64(37) + shape[1:])]
        grams += [_mix((shape[:-2] * np.uint64(41) + shape[1:-1]) * np.uint64(43) + shape[2:])]
        return np.unique((np.concatenate(grams) & np.uint64(self.mask)).astype(np.int32))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = SMOOTH) -> np.ndarray:
    """Log ratio of the share of each bucket's indicators, class 1 over class 0."""
    counts = [np.full(size, smooth), np.full(size, smooth)]
    for buckets, label in zip(rows, labels, strict=True):
        counts[label][buckets] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows, labels, ratios, size, epochs=EPOCHS, cost=COST, seed=1) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on scaled indicators of unit length.

    Rows are scaled when they are visited, as copies of all would double the task's memory.
    One dual variable per row, kept between 0 and ``cost`` (times the class's weight); each step
    solves for one of them exactly and moves the weights along its row.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    most = cost * 0.5 / np.maximum(share, 1e-9)[labels]
    lengths = [max(np.sqrt(ratios[r] @ ratios[r]), 1e-12) for r in rows]
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            buckets = rows[i]
            x = ratios[buckets] / lengths[i]
            slope = sign[i] * (weights[buckets] @ x + bias) - 1
            step = min(max(alpha[i] - slope / (2.0 if len(x) else 1.0), 0.0), most[i])
            if step != alpha[i]:
                move = (step - alpha[i]) * sign[i]
                weights[buckets] += move * x
                bias += move
                alpha[i] = step
    return weights, bias


def margins(rows, ratios, weights, bias) -> np.ndarray:
    out = np.empty(len(rows))
    for i, buckets in enumerate(rows):
        scale = ratios[buckets]
        out[i] = (weights[buckets] @ scale) / max(np.sqrt(scale @ scale), 1e-12) + bias
    return out


def logistic_curve(values, labels, weight) -> tuple[float, float]:
    """Slope and offset that fit the labels best, by Newton steps on smoothed targets."""
    slope, offset = 1.0, 0.0
    target = np.where(labels == 1, 0.999, 0.001)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * values + offset, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * values).sum() + 1e-3 * slope, g.sum()])
        hess = np.array([[(h * values**2).sum() + 1e-3, (h * values).sum()], [(h * values).sum(), h.sum()]])
        slope, offset = np.array([slope, offset]) - np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
    return max(float(slope), 1e-3), float(offset)


def train(texts: list[bytes], labels: np.ndarray, totals: tuple[int, int], bits: int = BITS) -> dict:
    """Model of labelled texts; ``totals`` are the class sizes among all labels."""
    if not len(labels):
        return {"constant": 0.5}
    if labels.min() == labels.max():
        return {"constant": float(labels[0])}
    features, size = Features(bits), 1 << bits
    rows = [features.of(t) for t in texts]
    fold = np.arange(len(rows)) % 5 == 4
    if len(set(labels[fold])) < 2 or len(set(labels[~fold])) < 2:
        fold = np.zeros(len(rows), bool)
    fit = np.flatnonzero(~fold)
    mine = [rows[i] for i in fit]
    ratios = log_count_ratios(mine, labels[fit], size)
    weights, bias = dual_descent(mine, labels[fit], ratios, size)
    held = np.flatnonzero(fold) if fold.any() else fit
    values = margins([rows[i] for i in held], ratios, weights, bias)
    counts = np.bincount(labels[held], minlength=2)
    weight = (np.array(totals) / np.maximum(counts, 1))[labels[held]]
    slope, offset = logistic_curve(values, labels[held], weight / weight.mean())
    return {
        "ratios": ratios.astype(np.float32),
        "weights": (weights * ratios).astype(np.float32),
        "bias": bias, "slope": slope, "offset": offset, "bits": bits,
    }


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS) -> dict:
    """Model of ``labels(doc_id, quality)``; rows whose crc32 modulo 4 is 2 are held out."""
    known = checkpointed(
        labels.where("quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("other"))
        .where((F.col("quality") == F.col("other")) & (crc_mod(F.col("doc_id"), 4) != 2))
        .select(F.col("doc_id").alias("__id"), "quality"),
        "labels",
    )
    totals = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("quality") == value).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    chosen = checkpointed(chosen, "chosen")  # at most 2 * per_class rows
    sizes = (totals.get(0, 0), totals.get(1, 0))
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
        .select(F.xxhash64("doc_id").alias("key"), "doc_id", "quality", "text")
        .groupBy("key", "doc_id", "quality")  # of texts that share an id the one with the least hash
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .repartition(1)
        .sortWithinPartitions("key", "doc_id")
        .select("quality", "text")
    )

    def run(batches):
        texts, quality = [], []
        for batch in batches:
            quality += batch.column(0).to_pylist()
            texts += texts_of(batch.column(1))
        model = train(texts, np.array(quality, np.int64), sizes, bits)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = [bytes(r[0]) for r in rows.mapInArrow(run, "model binary").collect()]
    return pickle.loads(found[0]) if found else {"constant": 0.5}


def scores(model: dict, texts: list[bytes | None], features: Features | None = None) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    features = features or Features(model["bits"])
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        buckets = features.of(text)
        scale = model["ratios"][buckets].astype(np.float64)
        value = model["weights"][buckets].sum(dtype=np.float64) / max(np.sqrt(scale @ scale), 1e-12)
        out[i] = value + model["bias"]
    return (1 / (1 + np.exp(-np.clip(model["slope"] * out + model["offset"], -30, 30)))).round(6)


def with_scores(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``docs`` plus the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features(shared.value.get("bits", BITS))
        for batch in texts:
            yield pa.array(scores(shared.value, texts_of(batch), features))

    return docs.withColumn(column, score.asNondeterministic()(F.col("text")))
