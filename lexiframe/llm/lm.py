"""LM scoring with a small causal self-attention model (operator 3).

Two scores per document, both over its lower-cased words and one end:

* ``base_score``: a unigram model with exact counts over all training documents.
* ``score``: log10 probability under a class-based attention model on subword ids.  A public BPE
  vocabulary cuts words into subwords; their counts over the corpus put them into classes of about
  equal mass.  Attention over the subwords before gives the distribution of the next class; counts of
  subwords, and of pairs within words, give the subword within its class.

The model is trained in numpy on every block of every training document, its start and end included,
with the same passes at every size; tasks train on their own windows and the parameters are averaged
after each round.  Scoring cuts a document into blocks; a block and the block
before it are one context window, in which all queries of many blocks are answered by batched masked
attention, so windows overlap by half and every token is scored once.

Texts are cut into words twice: to count the words, and into the pieces that hold the subword ids of all
documents, from which the model is trained and every document scored.

Word counts stay distributed.  Only words above a count are broadcast (at most ``KNOWN_WORDS``); all
others are counted per document and joined, which is free of hot keys as those words are rare.

Defined results: null or empty text is one end token; without training documents counts are 0 and the
model is untrained; repeated rows are scored each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexiframe.llm.words import coded_words, text_slices, words_of  # noqa: F401
from lexiframe.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"  # a space goes before every word
KNOWN_WORDS = 1 << 19
COUNTED_BYTES = 1 << 23  # of text whose words a task counts at once
CUT_BYTES, CUT_ROWS = 1 << 21, 1024  # of text cut at once
CUT_WORDS = 1 << 18  # that a task holds beside the known ones
ENCODED_AT_ONCE = 1024  # words
CLASSES = 48  # half for subwords that begin a word, half for those within words
SYMBOLS = 1024
GROUPS = 6  # of symbols that stand in the same windows
TRUST = 4.0  # pseudo-counts with which a class's shares enter its pair counts
BLOCK = 16
WIDTH = 16
PIECE_BLOCKS = 64  # blocks of a row of training text
ROUNDS = 1  # passes over all training text
WINDOWS_PER_TASK = 1 << 18
HELD = 1 << 14  # windows that a task shuffles at once
BATCH = 256
RATE = 0.01
SCORED_AT_ONCE = 128  # blocks
TASKS_PER_CORE = 2  # of those that return a table of pairs each
KEPT_BYTES = 1 << 23
SCORE_UNIT = 1e-8  # scores of pieces are summed as integers of it, in any order alike


# --- subwords ---------------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class SubwordEncoder:
    """Subword ids of words (UTF-8)."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values(), default=0) + 1, bool)
        self.begins[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True

    def __call__(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words in order, and their number per word."""
        ids, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), ENCODED_AT_ONCE):
            own = words[at : at + ENCODED_AT_ONCE]
            joined = b" ".join(own).decode("utf-8", "replace")
            if re.search(r"[^\S ]", joined):  # white space within words may take in the space after it
                lists = list(map(self, own))
                ids.append(np.array([i for one in lists for i in one], np.int32))
                sizes.append(np.array(list(map(len, lists)), np.int64))
                continue
            ids.append(np.array(self.encoding.encode_ordinary(" " + joined), np.int32))
            starts = np.flatnonzero(self.begins[ids[-1]])  # only the first subword of a word holds a space
            sizes.append(np.diff(np.append(starts, len(ids[-1]))))
        return np.concatenate(ids), np.concatenate(sizes)


def subword_encoder(ranks: dict[bytes, int]) -> SubwordEncoder:
    return SubwordEncoder(ranks)


def keep_freed_memory() -> None:
    """Let this process keep some MB that it frees.

    glibc gives freed memory back beyond twice the largest block freed so far.  Kernels that free and take the
    same arrays for every batch otherwise spend up to half of their time in page faults.
    """
    np.empty(KEPT_BYTES, np.uint8)  # freed untouched


class _Rows(dict):
    """Row of a word; a word not met before gets the next one."""

    def __init__(self, lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> int:
        self[word] = row = self.lexicon.add(word)
        return row


class Lexicon:
    """Rows of words: counts of known ones, subwords of all that a task has met."""

    def __init__(self, encode, words: list[bytes] = (), most: int = 1 << 20):
        self.encode, self.first, self.most = encode, list(words), most
        self._reset()

    def _reset(self):
        self.names = list(self.first)
        self.rows = _Rows(self)
        self.rows.update(zip(self.names, range(len(self.names)), strict=True))
        self.start = np.full(max(1 << 16, len(self.names) * 2), -1, np.int64)
        self.length = np.zeros(len(self.start), np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def add(self, word: bytes) -> int:
        row = len(self.names)
        self.names.append(word)
        if row == len(self.start):
            self.start = np.concatenate([self.start, np.full(row, -1, np.int64)])
            self.length = np.concatenate([self.length, np.zeros(row, np.int64)])
        return row

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.names) > self.most + len(self.first):
            self._reset()
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def subwords(self, rows: np.ndarray) -> np.ndarray:
        """Subword ids of the words in order."""
        if not len(rows):
            return np.empty(0, np.int32)
        new = np.unique(rows[self.start[rows] < 0])
        if len(new):
            ids, sizes = self.encode.many([self.names[row] for row in new.tolist()])
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[new], self.length[new] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(ids)
        size = self.length[rows]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[rows] - ends + size, size) + np.arange(ends[-1])]


# --- counts -----------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts of ``docs``."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", COUNTED_BYTES):
                words, codes, _ = coded_words(part.column("text"))
                n = np.bincount(codes, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"])

    found = docs.select("text").mapInArrow(run, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = KNOWN_WORDS) -> DataFrame:
    """The words above the smallest count that at most ``most`` words reach."""
    bins = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("words"), F.min("n").alias("least")
    )
    total, least = 0, None
    for row in sorted(bins.collect(), reverse=True):  # eight bins per power of two
        total += row["words"]
        if total > most:
            break
        least = row["least"]
    return counts.where(F.col("n") >= least) if least is not None else counts.limit(0)


def encoded_words(counts: DataFrame, ranks) -> DataFrame:
    """``ids, n``: subwords of every counted word."""

    def run(batches):
        encode = subword_encoder(ranks.value)
        for batch in batches:
            ids, sizes = encode.many(batch.column(0).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["ids", "n"])

    return counts.select("word", "n").mapInArrow(run, "ids array<int>, n bigint")


def fill(into: np.ndarray, cells: DataFrame) -> None:
    """Put the values of ``cells`` (place, value) into an array of bounded size.

    The driver gets them as Arrow columns; a table of a million cells as Python rows takes it hundreds of MB.
    """
    got = cells.toArrow()
    into[got.column(0).to_numpy()] = got.column(1).to_numpy()


def symbol_table(counts: np.ndarray, begins: np.ndarray, ends: int, symbols: int = SYMBOLS) -> dict:
    """Masses and symbols of all subword ids; the last id is the end.

    The ``symbols`` most frequent ids are symbols of their own and the rest share one; two more
    stand for start and padding.
    """
    mass = np.append(counts, ends).astype(np.float64) + 0.01
    top = np.argsort(-mass, kind="stable")[:symbols]
    symbol = np.full(len(mass), symbols, np.int16)
    symbol[top] = np.arange(len(top))
    return {"mass": mass, "begins": np.append(begins, True), "symbol": symbol, "symbols": symbols}


def symbol_groups(pieces: DataFrame, shared, symbols: int = SYMBOLS, groups: int = GROUPS) -> np.ndarray:
    """Group of every symbol by the windows it stands in (texts of a language, say).

    Counts of pairs of symbols in a window, over all windows, give a similarity; its leading
    eigenvectors are clustered.
    """

    def run(batches):
        keep_freed_memory()
        table, side = shared.value["symbol"], symbols + 1
        found = np.zeros(side * side, np.int64)
        for rows, _ in window_chunks(batches, table, 4096):
            rows = np.sort(np.minimum(rows, symbols), axis=1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = symbols  # a symbol counts once in a window
            rows.sort(axis=1)
            many = (rows < symbols).sum(1)
            rows = rows[np.argsort(-many, kind="stable")].T.astype(np.int64)  # windows of many symbols first
            first, cells = rows * side, []
            for place in range(2 * BLOCK):
                own = int((many > place).sum())  # windows with a symbol at this place
                cells.append((first[: place + 1, :own] + rows[place, :own]).ravel())
            found += np.bincount(np.concatenate(cells), minlength=len(found))
        found = found.reshape(side, side)[:symbols, :symbols].ravel()  # the smaller symbol first
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["cell", "n"])

    pairs = np.zeros(symbols * symbols)
    tasks = TASKS_PER_CORE * pieces.sparkSession.sparkContext.defaultParallelism  # each returns a table of cells
    counted = pieces.select("first", "ids").coalesce(tasks).mapInArrow(run, "cell bigint, n bigint")
    fill(pairs, counted.groupBy("cell").agg(F.sum("n")))  # symbols squared at most
    pairs = pairs.reshape(symbols, symbols)
    pairs = pairs + np.triu(pairs, 1).T
    single = np.diag(pairs).copy()
    np.fill_diagonal(pairs, 0)
    expected = np.outer(single, single) / max(single.sum(), 1)
    similar = np.log1p(np.maximum(pairs / np.maximum(expected, 1e-9) - 1, 0))
    values, vectors = np.linalg.eigh(similar)
    points = vectors[:, -groups:] * np.sqrt(np.maximum(values[-groups:], 0))
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    centres = points[:1]
    while len(centres) < groups:  # farthest points first, then the usual rounds
        centres = np.vstack([centres, points[np.argmin((points @ centres.T).max(1))]])
    for _ in range(20):
        group = np.argmax(points @ centres.T, axis=1)
        centres = np.array([points[group == g].sum(0) if (group == g).any() else centres[g] for g in range(groups)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return group


def subword_tables(base: dict, group: np.ndarray, classes: int = CLASSES) -> dict:
    """Class, unit and share of every subword id.

    Ids that begin a word (and the end) and ids within words have classes of their own; each half is
    cut, by group and falling count, into about equal masses.  The units of a class are its symbols
    and one for all its other ids, in which ``share`` is an id's part.
    """
    mass, symbol, symbols = base["mass"], base["symbol"], base["symbols"]
    of = np.append(group, len(group) + 1)[np.minimum(symbol, symbols)]  # other ids come last
    kind, half = np.empty(len(mass), np.int16), classes // 2
    for first, which in ((0, base["begins"]), (half, ~base["begins"])):
        ids = np.flatnonzero(which)
        order = ids[np.lexsort((ids, -mass[ids], of[ids]))]
        before = np.cumsum(mass[order]) - mass[order]
        kind[order] = first + np.minimum(before / max(mass[order].sum(), 1e-9) * half, half - 1)
    unit = np.where(symbol < symbols, symbol, symbols + kind).astype(np.int64)
    whole = np.bincount(unit, weights=mass, minlength=symbols + classes)
    unit_kind = np.zeros(symbols + classes, np.int64)
    unit_kind[unit] = kind
    in_class = np.bincount(kind, weights=mass, minlength=classes)
    return base | {
        "kind": kind, "unit": unit, "share": np.log10(mass / whole[unit]), "unit_kind": unit_kind,
        "prior": whole / np.maximum(in_class[unit_kind], 1e-9), "classes": classes,
    }


def pair_table(encoded: DataFrame, shared, tables: dict) -> np.ndarray:
    """log10 share of a unit in its class after a symbol, from all pairs within words.

    Units that begin words do not depend on the symbol before.  The table's size is fixed.
    """
    symbols, units = tables["symbols"], len(tables["prior"])

    def run(batches):
        t, found = shared.value, np.zeros((symbols + 1) * units, np.int64)
        for batch in batches:
            lists = batch.column(0)
            ids = t["symbol"][lists.flatten().to_numpy()].astype(np.int64)
            unit = t["unit"][lists.flatten().to_numpy()]
            sizes = np.diff(lists.offsets.to_numpy())
            n = np.repeat(batch.column(1).to_numpy(), sizes)
            inside = np.ones(len(ids), bool)
            inside[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
            at = np.flatnonzero(inside)
            found += np.bincount(ids[at - 1] * units + unit[at], weights=n[at], minlength=len(found)).astype(np.int64)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["cell", "n"])

    counts = np.zeros((symbols + 3) * units)
    fill(counts, encoded.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")))
    counts = counts.reshape(-1, units)
    kinds, prior = tables["unit_kind"], tables["prior"]
    totals = np.zeros((len(counts), tables["classes"]))
    for kind in range(tables["classes"]):
        totals[:, kind] = counts[:, kinds == kind].sum(1)
    shares = (counts + TRUST * prior) / (totals[:, kinds] + TRUST)
    begins = kinds < tables["classes"] // 2
    shares[:, begins] = prior[begins]
    return np.log10(np.maximum(shares, 1e-12)).astype(np.float32)


# --- model ------------------------------------------------------------------------------------

SHAPES = (
    ("embed", (SYMBOLS + 3, WIDTH)),
    ("query", (WIDTH, WIDTH)),
    ("key", (WIDTH, WIDTH)),
    ("value", (WIDTH, WIDTH)),
    ("near", (2 * BLOCK,)),
    ("mix", (WIDTH, WIDTH)),
    ("own", (WIDTH, WIDTH)),
    ("shift", (WIDTH,)),
    ("out", (WIDTH, CLASSES)),
    ("bias", (CLASSES,)),
)
START, PAD = SYMBOLS + 1, SYMBOLS + 2
_QUERY_AT, _KEY_AT = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None, :]
_BACK = np.clip(_QUERY_AT - _KEY_AT, 0, 2 * BLOCK - 1)
_FUTURE = np.where(_KEY_AT > _QUERY_AT, np.float32(-1e9), np.float32(0))


def new_parameters(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = lambda shape: 0.0 if len(shape) == 1 else 1 / np.sqrt(WIDTH)
    return {n: (rng.standard_normal(s) * scale(s)).astype(np.float32) for n, s in SHAPES}


def flat(parameters: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parameters[n].ravel() for n, _ in SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES:
        size = int(np.prod(shape))
        out[name] = np.asarray(values[at : at + size], np.float32).reshape(shape)
        at += size
    return out


def _bounded(x, bound: float):
    """Exponents in place; those not known to stay below 60 are shifted by their maximum."""
    if not bound < 60:
        x -= x.max(-1, keepdims=True)
    return np.exp(x, out=x)


def _lengths(x) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))


def _by_symbol(rows, symbols, many: int):
    """Sums of the rows of every symbol."""
    order = np.argsort(symbols, axis=None, kind="stable")
    at = symbols.ravel()[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    pairs = rows.reshape(len(at), -1).take(order, 0).view(np.result_type(rows, np.complex64))  # two columns at once
    out = np.zeros((many, rows.shape[-1]), rows.dtype)
    out[at[starts]] = np.add.reduceat(pairs, starts, axis=0).view(rows.dtype)
    return out


def gradients(p: dict, symbols: np.ndarray, kinds: np.ndarray) -> tuple[float, dict]:
    """Mean loss of the second half of every window and its gradient; kind -1 is not scored.

    Products with parameters are taken once per symbol instead of once per place, forwards and backwards.
    """
    embed, number = p["embed"], p["embed"].dtype.type
    scale = number(1 / np.sqrt(WIDTH))
    own = symbols[:, BLOCK:]
    value = embed @ p["value"]
    meets = np.concatenate([embed @ p["key"], value @ p["mix"]], 1)
    looks = np.concatenate([embed @ p["query"] * scale, embed @ p["own"] + p["shift"]], 1)
    kv = meets.take(symbols.ravel(), 0).reshape(*symbols.shape, 2 * WIDTH)
    qr = looks.take(own.ravel(), 0).reshape(*own.shape, 2 * WIDTH)
    q, k, v = qr[:, :, :WIDTH], kv[:, :, :WIDTH], kv[:, :, WIDTH:]
    a = q @ k.swapaxes(1, 2)
    a += p["near"][_BACK] + _FUTURE
    padded = np.flatnonzero((symbols == PAD).any(1))
    if len(padded):
        a[padded] += np.where(symbols[padded] == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
    _bounded(a, _lengths(looks[:, :WIDTH]) * _lengths(meets[:, :WIDTH]) + float(np.abs(p["near"]).max()))
    a *= (1 / (a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, number))).reshape(*own.shape, 1)
    c = a @ v
    h = c + qr[:, :, WIDTH:]
    h = np.tanh(h, out=h).reshape(-1, WIDTH)
    z = h @ p["out"]
    z += p["bias"]
    _bounded(z, float(np.abs(p["out"]).sum(0).max() + np.abs(p["bias"]).max()))
    total = z @ np.ones(CLASSES, number)
    wanted = kinds.ravel()
    valid = wanted >= 0
    count = max(1, int(valid.sum()))
    at = np.arange(0, z.size, CLASSES) + np.where(valid, wanted, 0)
    cells = z.ravel()
    loss = -np.log(np.maximum(cells[at] / total, 1e-30))[valid].sum() / count
    each = valid * number(1 / count)
    z *= (each / total)[:, None]
    cells[at] -= each
    ones = np.ones(len(z), number)
    g = {"out": h.T @ z, "bias": ones @ z}
    dh = z @ p["out"].T
    dh *= 1 - h * h
    g["shift"] = ones @ dh
    dc = dh.reshape(c.shape)
    ds = dc @ v.swapaxes(1, 2)
    ds -= np.einsum("ijk,ijk->ij", dc, c)[:, :, None]
    ds *= a
    g["near"] = np.bincount(_BACK.ravel(), weights=ds.sum(0).ravel(), minlength=2 * BLOCK)
    dkv, dqr = np.empty_like(kv), np.empty_like(qr)
    np.matmul(ds.swapaxes(1, 2), q, out=dkv[:, :, :WIDTH])
    np.matmul(a.swapaxes(1, 2), dc, out=dkv[:, :, WIDTH:])
    np.matmul(ds, k, out=dqr[:, :, :WIDTH])
    dqr[:, :, WIDTH:] = dc
    met, looked = _by_symbol(dkv, symbols, len(embed)), _by_symbol(dqr, own, len(embed))
    g["mix"] = value.T @ met[:, WIDTH:]
    met[:, WIDTH:] = met[:, WIDTH:] @ p["mix"].T
    looked[:, :WIDTH] *= scale
    for names, sums in ((("key", "value"), met), (("query", "own"), looked)):
        g |= zip(names, np.split(embed.T @ sums, 2, axis=1), strict=True)
    both = np.concatenate([p["key"], p["value"]], 1), np.concatenate([p["query"], p["own"]], 1)
    g["embed"] = met @ both[0].T + looked @ both[1].T
    return float(loss), g


def piece_windows(ids: np.ndarray, first: bool, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and the ids to predict (-1: padding) of a piece of ``training_pieces``."""
    body = ids if first else ids[BLOCK + 1 :]
    count = -(-len(body) // BLOCK)
    past, ahead = np.full((count + 1) * BLOCK, PAD, np.int16), np.full(count * BLOCK, -1, np.int32)
    if first:
        past[BLOCK] = START
        past[BLOCK + 1 : BLOCK + len(body)] = symbol[body[:-1]]
    else:
        past[: BLOCK + len(body)] = symbol[ids[:-1]]
    ahead[: len(body)] = body
    past = past.reshape(-1, BLOCK)
    return np.concatenate([past[:-1], past[1:]], 1), ahead.reshape(-1, BLOCK)


def id_type(ids: int):
    """How pieces store ids below ``ids``."""
    return np.dtype("<u2" if ids <= 1 << 16 else "<i4")


def window_chunks(batches, symbol: np.ndarray, most: int = HELD):
    """Windows of batches of ``first, ids``, about ``most`` at once."""
    held, size, kind = [], 0, id_type(len(symbol))
    for batch in batches:
        for first, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append(piece_windows(np.frombuffer(ids, kind), first, symbol))
            size += len(held[-1][0])
            if size >= most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def train_locally(p: dict, chunks, steps: int, rate: float = RATE) -> tuple[dict, int]:
    """Adam over chunks of windows and kinds, with speed that falls over ``steps``; also their number."""
    values = flat(p).astype(np.float32)
    first, second = np.zeros_like(values), np.zeros_like(values)
    step = seen = 0
    for symbols, kinds in _batches(chunks):
        g = flat(gradients(unflat(values), symbols, kinds)[1]).astype(np.float32)
        speed = rate * (1 - min(1, step / steps) * 0.9)
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        m, s = first / (1 - 0.9 ** (step + 1)), second / (1 - 0.99 ** (step + 1))
        values -= speed * m / (np.sqrt(s) + 1e-8)
        step, seen = step + 1, seen + len(symbols)
    return unflat(values), seen


def _batches(chunks):
    """``BATCH`` windows at a time, each chunk in random order; what is left goes with the next chunk."""
    rng, left = np.random.default_rng(0), None
    for chunk in chunks:
        if left is not None:
            chunk = tuple(np.concatenate(x) for x in zip(left, chunk, strict=True))
        order = rng.permutation(len(chunk[0]))
        whole = len(order) // BATCH * BATCH
        for at in range(0, whole, BATCH):
            some = order[at : at + BATCH]
            yield chunk[0][some], chunk[1][some]
        left = tuple(x[order[whole:]] for x in chunk)
    if left is not None and len(left[0]):
        yield left


#: What is known of a document beside its subwords, on its first piece: ``rare`` holds its words outside the known ones.
PIECE_FACTS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()),
    T.StructField("logs", T.DoubleType()),
    T.StructField("n_subwords", T.LongType()),
    T.StructField("rare", T.ArrayType(T.BinaryType())),
    T.StructField("times", T.ArrayType(T.IntegerType())),
]


def training_pieces(docs: DataFrame, end: int, ranks, most: int = PIECE_BLOCKS, known=None) -> DataFrame:
    """``first, ids``: subwords and end of every document, in rows of at most ``most`` blocks.

    All rows of a document but the first begin with the ``BLOCK + 1`` ids before them.  ``PIECE_FACTS`` and the other
    columns of ``docs`` follow.  ``known`` is a broadcast of the words counted one by one, with their logarithms and those of the ends.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]
    out = T.StructType([T.StructField("first", T.BooleanType()), T.StructField("ids", T.BinaryType()), *PIECE_FACTS, *others])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def run(batches):
        keep_freed_memory()
        held = known.value if known else {"words": [], "logs": np.zeros(0), "end": 0.0, "ends": 0}
        lexicon, kind = Lexicon(subword_encoder(ranks.value), held["words"], CUT_WORDS), id_type(end + 1)
        many, logs = len(held["words"]), np.append(held["logs"], 0.0)
        for batch in batches:
            for part in text_slices(batch, "text", CUT_BYTES, CUT_ROWS):
                words, codes, sizes = coded_words(part.column("text"))
                of = lexicon.of(words.to_pylist())
                rows, owner = of[codes], np.repeat(np.arange(len(sizes)), sizes)
                ids = lexicon.subwords(rows)
                stops = np.append(0, np.cumsum(lexicon.length[rows]))[np.cumsum(sizes)]
                data = np.insert(ids, stops, end).astype(kind).tobytes()
                common = rows < many
                other, times = np.unique(owner[~common] * len(words) + codes[~common], return_counts=True)
                lists = pa.array(np.append(0, np.cumsum(np.bincount(other // max(len(words), 1), minlength=len(sizes)))), pa.int32())
                lengths = np.diff(stops, prepend=0)
                facts = [
                    sizes + 1,
                    np.bincount(owner, common, len(sizes)).astype(np.int64) + (held["ends"] > 0),
                    np.bincount(owner, logs[np.where(common, rows, many)], len(sizes)) + held["end"],
                    lengths,
                    pa.ListArray.from_arrays(lists, words.take(pa.array(other % max(len(words), 1)))),
                    pa.ListArray.from_arrays(lists, pa.array(times, pa.int32())),
                ]
                doc, pieces, at = [], [], 0
                for number, length in enumerate((lengths + 1).tolist()):
                    for start in range(0, length, most * BLOCK):
                        cut = at + max(0, start - BLOCK - 1), at + min(length, start + most * BLOCK)
                        doc.append(number)
                        pieces.append(data[cut[0] * kind.itemsize : cut[1] * kind.itemsize])
                    at += length
                first = np.diff(doc, prepend=-1) > 0
                once = pa.array(doc, pa.int32(), mask=~first)
                columns = [pa.array(first), pa.array(pieces, pa.binary())]
                columns += [pa.array(x).take(once) if isinstance(x, np.ndarray) else x.take(once) for x in facts]
                columns += [part.column(f.name).take(pa.array(doc, pa.int32())) for f in others]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, out)


def dealt_pieces(pieces: DataFrame, tasks: int) -> DataFrame:
    """The rows written in ``tasks`` parts, dealt by their number: equal rows go to many parts."""
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.repartition(tasks, F.xxhash64("row")).sortWithinPartitions("row")
    return checkpointed(dealt.drop("row"), "pieces")


def train(pieces: DataFrame, shared, steps: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters averaged over tasks after every round; every round is one pass over all windows."""
    values = flat(new_parameters())
    spark = pieces.sparkSession
    for turn in range(rounds):
        started = spark.sparkContext.broadcast(values)
        rate = RATE / (1 + turn)

        def run(batches, started=started, rate=rate):
            keep_freed_memory()
            t = shared.value
            kind_of = np.append(t["kind"], -1).astype(np.int64)  # id -1 is not scored
            chunks = ((symbols, kind_of[ahead]) for symbols, ahead in window_chunks(batches, t["symbol"]))
            p, seen = train_locally(unflat(started.value), chunks, steps, rate)
            if seen:
                new = flat(p).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(new) + 1)), pa.array(np.append(new, 1.0) * seen)], ["at", "x"]
                )

        total = np.zeros(len(values) + 1)
        got = pieces.select("first", "ids").mapInArrow(run, "at bigint, x double")
        fill(total, got.groupBy("at").agg(F.sum("x")))  # one row per parameter
        if not total[-1]:
            break
        values = (total[:-1] / total[-1]).astype(np.float32)
        started.unpersist()
    return unflat(values)


class Scorer:
    """log10 probabilities of documents given as lists of subword ids."""

    def __init__(self, parameters: dict, tables: dict):
        p, self.t = parameters, tables
        scale = np.float32(1 / np.sqrt(WIDTH))
        self.q = p["embed"] @ p["query"] * scale
        self.k = p["embed"] @ p["key"]
        # keys, mixed values and a last column of ones, which sums the weights along with the values
        ones = np.ones((len(p["embed"]), 1), np.float32)
        self.kv = np.concatenate([self.k, p["embed"] @ p["value"] @ p["mix"], ones], 1)
        self.out = np.concatenate([p["out"], p["bias"][None]]).astype(np.float32)
        self.sum = np.ones(CLASSES, np.float32)
        self.r = p["embed"] @ p["own"] + p["shift"]
        self.base = p["near"][_BACK] + _FUTURE
        self.p = p
        self.end = len(tables["kind"]) - 1
        # exponents below this need no shift by their maximum
        self.tame = {
            "attend": float(np.linalg.norm(self.q, axis=1).max() * np.linalg.norm(self.k, axis=1).max() + p["near"].max()) < 60,
            "out": float(np.abs(p["out"]).sum(0).max() + np.abs(p["bias"]).max()) < 60,
        }

    def blocks(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of symbols and the ids to predict (-1: padding) of one document."""
        count = len(ids) // BLOCK + 1
        past = np.full((count + 1) * BLOCK, PAD, np.int16)
        past[BLOCK] = START
        past[BLOCK + 1 : BLOCK + 1 + len(ids)] = self.t["symbol"][ids]
        ahead = np.full(count * BLOCK, -1, np.int32)
        ahead[: len(ids)] = ids
        ahead[len(ids)] = self.end
        past = past.reshape(-1, BLOCK)
        return np.concatenate([past[:-1], past[1:]], 1), ahead.reshape(-1, BLOCK)

    def block_scores(self, symbols: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Sum of log10 probabilities per block."""
        own = symbols[:, BLOCK:]
        kv = self.kv[symbols]
        a = self.q[own] @ kv[:, :, :WIDTH].swapaxes(1, 2)
        a += self.base
        padded = np.flatnonzero((symbols == PAD).any(1))
        if len(padded):
            a[padded] += np.where(symbols[padded] == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
        if not self.tame["attend"]:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        # one product per block, all of one shape: a block's score does not depend on those beside it
        c = a @ kv[:, :, WIDTH:]
        h = c[:, :, :WIDTH] / c[:, :, WIDTH:]
        h += self.r[own]
        whole = np.ones((*own.shape, WIDTH + 1), np.float32)
        np.tanh(h, out=whole[:, :, :WIDTH])
        z = (whole @ self.out).reshape(own.size, -1)
        if not self.tame["out"]:
            z -= z.max(1, keepdims=True)
        flat_ids = ahead.ravel()
        valid = flat_ids >= 0
        ids = np.where(valid, flat_ids, self.end)
        chosen = z[np.arange(len(z)), self.t["kind"][ids]]
        np.exp(z, out=z)
        total = (z.reshape(*own.shape, -1) @ self.sum).ravel()
        logs = (chosen - np.log(total)) * 0.4342944819032518
        logs = logs + self.t["share"][ids] + self.t["pairs"][own.ravel(), self.t["unit"][ids]]
        return np.where(valid, logs, 0.0).reshape(-1, BLOCK).sum(1)

    def scores(self, documents: list[np.ndarray]) -> np.ndarray:
        """Documents of any length."""
        return self.totals([self.blocks(ids) for ids in documents])

    def totals(self, windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Sums over the blocks of each entry, ``SCORED_AT_ONCE`` blocks at a time."""
        out = np.zeros(len(windows))
        held, owners, size = [], [], 0

        def flush():
            symbols, ahead = (np.concatenate(x) for x in zip(*held, strict=True))
            np.add.at(out, np.repeat(*np.array(owners).T), self.block_scores(symbols, ahead))

        for number, (symbols, ahead) in enumerate(windows):
            for at in range(0, len(symbols), SCORED_AT_ONCE):
                part = (symbols[at : at + SCORED_AT_ONCE], ahead[at : at + SCORED_AT_ONCE])
                held.append(part)
                owners.append((number, len(part[0])))
                size += len(part[0])
                if size >= SCORED_AT_ONCE:
                    flush()
                    held, owners, size = [], [], 0
        if held:
            flush()
        return out


# --- scoring ----------------------------------------------------------------------------------

SCORED_TYPE = "uid bigint, doc_id bigint, part bigint, n_tokens bigint, n_known bigint, logs double, n_subwords bigint"
PIECES_AT_ONCE = 256


def lm_scores(docs: DataFrame, train_on, tokenizer: str = TOKENIZER, known_words: int = KNOWN_WORDS) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)``; ``train_on`` is a condition on its columns."""
    spark = docs.sparkSession
    trained = F.coalesce(train_on, F.lit(False)).alias("trained")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text")).select("doc_id", "text", trained)
    training = docs.where("trained")
    ranks = spark.sparkContext.broadcast(read_ranks(tokenizer))
    counts = checkpointed(word_counts(training), "words")
    row = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    ends = training.count()
    tokens, distinct = (row[0] or 0) + ends, row[1] + (ends > 0)
    known = frequent_words(counts, known_words).select("word", "n").toArrow()  # at most known_words rows
    known_n = known.column(1).to_numpy()
    least = int(known_n.min()) if len(known_n) else None
    lexical = spark.sparkContext.broadcast(
        {
            "words": known.column(0).to_pylist(),
            "logs": np.log10(known_n + 0.1),
            "end": float(np.log10(ends + 0.1)),
            "ends": ends,
        }
    )
    del known, known_n
    encoded = checkpointed(encoded_words(counts, ranks), "encoded")
    found = np.zeros(len(ranks.value), np.int64)
    by_id = encoded.select("n", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("n"))
    fill(found, by_id)  # at most one row per subword id
    begins = np.array([t.startswith(b" ") for t, _ in sorted(ranks.value.items(), key=lambda x: x[1])])
    base = symbol_table(found, begins, ends)
    shared = spark.sparkContext.broadcast(base)
    count = int(found.sum()) // BLOCK + ends  # windows, at most
    tasks = max(1, -(-count // WINDOWS_PER_TASK))
    numbered = docs.withColumn("uid", F.monotonically_increasing_id())
    pieces = dealt_pieces(training_pieces(numbered, len(base["symbol"]) - 1, ranks, known=lexical), tasks)
    learnt = pieces.where("trained")
    tables = subword_tables(base, symbol_groups(learnt, shared))
    shared = spark.sparkContext.broadcast(tables)
    tables = tables | {"pairs": pair_table(encoded, shared, tables)}
    parameters = train(learnt, shared, max(1, count // tasks // BATCH))
    model = spark.sparkContext.broadcast({"tables": tables, "parameters": parameters})

    def run(batches):
        keep_freed_memory()
        scorer = Scorer(model.value["parameters"], model.value["tables"])
        symbol = scorer.t["symbol"]
        kind = id_type(len(symbol))
        for whole in batches:
            for at in range(0, whole.num_rows, PIECES_AT_ONCE):
                batch = whole.slice(at, PIECES_AT_ONCE)
                rows = zip(batch.column("first").to_pylist(), batch.column("ids").to_pylist(), strict=True)
                scores = scorer.totals([piece_windows(np.frombuffer(ids, kind), first, symbol) for first, ids in rows])
                parts = pa.array(np.rint(scores / SCORE_UNIT).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[2:4], parts, *batch.columns[4:]], [*names[2:4], "part", *names[4:]])

    names = ["first", "ids", "uid", "doc_id", "n_tokens", "n_known", "logs", "n_subwords"]
    scored = checkpointed(pieces.select(*names).mapInArrow(run, SCORED_TYPE), "scored")
    listed = pieces.where("first").select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r"))
    rest = counts.where(F.col("n") < least) if least is not None else counts
    more = (
        listed.select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
        .join(rest, "word", "left")
        .select(
            "uid",
            (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("logs"),
            F.when(F.col("n") > 0, F.col("times")).otherwise(0).cast("bigint").alias("n_known"),
        )
    )
    smooth = float(np.log10(tokens + 0.1 * (distinct + 1)))
    return (
        scored.unionByName(more, allowMissingColumns=True)
        .groupBy("uid")
        .agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("part", *names[4:])))
        .select(
            "doc_id",
            "n_tokens",
            "n_known",
            F.lit(tokens).cast("bigint").alias("train_tokens"),
            (F.col("logs") - F.col("n_tokens") * F.lit(smooth)).alias("base_score"),
            F.round(F.col("part") * SCORE_UNIT, 4).alias("score"),
            "n_subwords",
        )
    )
