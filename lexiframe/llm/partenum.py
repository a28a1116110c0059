"""N-gram Jaccard join by PartEnum signatures (operator 7).

A document is the set of its word shingles (64-bit hashes).  Sets are put into bands of sizes.  In a
band the hash domain is cut into ranges; a signature is one range's content.  Two sets that reach the
similarity differ in at most ``k`` shingles, where ``k`` follows from the smaller size, so at most ``k``
signatures of either are missing in the other.  Of its non-empty ranges a set keeps the ``k + 1`` whose
signatures are rarest in the table, in one order for all sets.  Every linked pair shares one that both
keep: let the smaller set's last kept signature come no later than the larger's (or the larger keep
all it has); one of its ``k + 1`` is in the larger set, and no later than that set's last, so kept.  The
other case is the same with the sets exchanged.  (This is the second level with subsets of one partition:
larger subsets would make empty contents count, which meet in buckets that grow with the table.)  A
passage that many documents share makes frequent signatures, which documents that share nothing else do
not keep, so it ties none of them.  A set near a band's lower end also signs in the band below, for its
smaller partners.  Sets with too few non-empty ranges make their bands sign once more with other
ranges, until none is left, so the join is exact.

Candidates are then verified.  Equal sets are one class from the start.  No list of candidate pairs
is made: a bucket ties its members to its smallest, its centre.  All tied sets are sorted by their
least centre and cut into blocks of bounded cost, so most candidates are within one block.  A block is
compared with itself; members of a centre that lie in several blocks are compared with those in the
centre's first block, and then only where two blocks are not yet one component.  A task holds at most
two blocks and returns a spanning forest.

This is done twice.  First with a short parity sketch per set: a shingle flips one bit, so sketches
never differ in more bits than their sets differ in shingles, and pairs that differ too much are
certainly not linked.  Documents that only share a passage go here, without their texts.  The
components of what is left are compared once more on whole texts, counting common shingles exactly.

Defined results: null or empty texts have no shingles and no links; documents with fewer words than a
shingle have one; null ids take part as rows and are ignored in minima; repeated ids, with equal or
other texts, are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.common import checked_broadcast, components, prefix_sums
from lexiframe.llm.words import mixed, shingle_hashes, texts_of, words_of
from lexiframe.session import checkpointed

WORDS = 5
PERCENT = 80
BAND_STEPS = 3  # a band spans (100 / percent) ** 3
BLOCK_COST = 1 << 19  # shingles of a block
ANCHOR_STEPS = 3
LEAST_COST = 512  # of a set, so that a block has about a thousand sets at most
LEAST_BITS = 64  # of a sketch
SKETCH_ROWS = 256  # sketches compared at once with those of similar size
RARE = 64  # shingles in more sets of a block are counted by matrix products


def band_bounds(percent: int, size: int) -> tuple[int, int, int]:
    """Number, smallest and largest size of the band of ``size``."""
    low, band = 1, 0
    while True:
        high = low
        for _ in range(BAND_STEPS):
            high = max(high, high * 100 // percent)
        if size <= high:
            return band, low, high
        low, band = high + 1, band + 1


def most_different(percent: int, size: int) -> int:
    """Shingles by which a set of ``size`` can differ from a linked set of its size or more."""
    return size * (100 - percent) // percent


def ranges_of(percent: int, high: int) -> int:
    """Ranges of a band: twice those that a set keeps, so that common contents need not be kept."""
    return 2 * (most_different(percent, high) + 1) + 6 + 200 // high


class Signer:
    """Signatures of sets; keeps the bands it has met."""

    def __init__(self, percent: int, salt: int, only: frozenset[int] | None):
        self.percent, self.salt, self.only, self.bands = percent, salt, only, {}

    def _band(self, size):
        if size not in self.bands:
            band, low, high = band_bounds(self.percent, size)
            plans = [(band, ranges_of(self.percent, high), most_different(self.percent, size) + 1)]
            if band and -(-size * self.percent // 100) < low:
                _, _, below = band_bounds(self.percent, low - 1)
                plans.append((band - 1, ranges_of(self.percent, below), most_different(self.percent, below) + 1))
            self.bands[size] = [p for p in plans if self.only is None or p[0] in self.only]
        return self.bands[size]

    @staticmethod
    def _ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)

    def sign(self, hashes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """All signatures of a set and the bands in which it has too few non-empty ranges."""
        runs, thin = self.runs(hashes)
        return np.concatenate([*(sigs for _, sigs in runs), np.empty(0, np.uint64)]), thin

    def runs(self, hashes: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], list[int]]:
        """Per band how many signatures to keep and those of all non-empty ranges; bands with too few."""
        out, thin = [], []
        if most_different(self.percent, len(hashes)) < 1:
            return out, thin  # only equal sets are similar enough
        plain = hashes
        if self.salt:
            hashes = np.sort(mixed(hashes, self.salt))
        weights, own = mixed(hashes, 7), band_bounds(self.percent, len(hashes))[0]
        for band, ranges, need in self._band(len(hashes)):
            part = self._ranges(hashes, ranges)
            starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
            # a set is thin as long as no salt so far has given it enough ranges
            if len(starts) < need and band == own and not any(
                len(np.unique(self._ranges(mixed(plain, salt) if salt else plain, ranges))) >= need
                for salt in range(self.salt)
            ):
                thin.append(band)
            sums = np.add.reduceat(weights, starts)
            place = (part[starts] << np.uint64(16)) ^ np.uint64(band * 64 + self.salt % 64)
            out.append((need, mixed(sums ^ mixed(place, 11))))
        return out, thin


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    sums = [mixed(hashes, salt).sum(dtype=np.uint64) for salt in (1, 2)]
    return tuple(np.array(sums, np.uint64).view(np.int64).tolist())


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Parities of the set's numbers of shingles in cells, a power of two that reaches its size.

    Halves of a sketch combined by XOR are the sketch with half as many cells.
    """
    bits = max(LEAST_BITS, 1 << max(0, len(hashes) - 1).bit_length())
    cells = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=bits).astype(np.uint8) & 1).tobytes()


RUNS = "array<struct<need:int,sigs:array<bigint>>>"
SET_TYPE = f"doc_id bigint, text_hash bigint, n bigint, k1 bigint, k2 bigint, runs {RUNS}, thin array<int>, bits binary"


def _signed_sets(docs: DataFrame, words: int, percent: int, salt: int = 0, only=None) -> DataFrame:
    """A row per document: hash of its text, size, 128-bit key of its set, signatures, thin bands, sketch."""

    def run(batches):
        signer = Signer(percent, salt, only)
        for batch in batches:
            sizes, keys, runs, thin, bits = [], [], [], [], []
            for text in texts_of(batch.column(2)):
                hashes = shingle_hashes(words_of(text), words)
                sizes.append(len(hashes))
                keys.append(set_key(hashes))
                bits.append(parity_sketch(hashes))
                own, bands = signer.runs(hashes)
                runs.append(own)
                thin.append(bands)
            key = np.array(keys, np.int64).reshape(-1, 2)
            flat = [run for own in runs for run in own]
            sigs = np.concatenate([*(s for _, s in flat), np.empty(0, np.uint64)]).view(np.int64)
            ends = pa.array(np.cumsum([0, *(len(s) for _, s in flat)]), pa.int32())
            needs = pa.array([need for need, _ in flat], pa.int32())
            structs = pa.StructArray.from_arrays(
                [needs, pa.ListArray.from_arrays(ends, pa.array(sigs))], ["need", "sigs"]
            )
            outer = pa.array(np.cumsum([0, *(len(own) for own in runs)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(key[:, 0].copy()),
                    pa.array(key[:, 1].copy()),
                    pa.ListArray.from_arrays(outer, structs),
                    pa.array(thin, pa.list_(pa.int32())),
                    pa.array(bits, pa.binary()),
                ],
                ["doc_id", "text_hash", "n", "k1", "k2", "runs", "thin", "bits"],
            )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text), text.alias("text")).mapInArrow(run, SET_TYPE)


def _signatures(signed: DataFrame, salt: int) -> DataFrame:
    """``uid, run, spare, sig``: every signature of sets, with how many more than it has their run may keep."""
    runs = signed.select("uid", F.posexplode("runs").alias("run", "of"))
    spare = (F.col("of.need") - F.size("of.sigs")).alias("spare")
    return runs.select("uid", (F.col("run") + 2 * salt).alias("run"), spare, F.explode("of.sigs").alias("sig"))


def _rarest(sigs: DataFrame) -> DataFrame:
    """``uid, sig`` of the signatures that runs keep, without those of a single set.

    The order is that of the number of sets, then the signature.  A run keeps ``need`` signatures, those
    of a single set first, so of the others as many as there are of them plus ``spare``.  All signatures
    are shuffled once, at any size of the table; one window holds a signature's rows, one those of a run.
    """
    common = sigs.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("sets > 1")
    run = Window.partitionBy("uid", "run")
    rank = F.row_number().over(run.orderBy("sets", "sig"))
    kept = common.withColumn("rank", rank).withColumn("several", F.count(F.lit(1)).over(run))
    return kept.where(F.col("rank") <= F.col("several") + F.col("spare")).select("uid", "sig").distinct()


def linked_sets(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Smallest member of the component of every set, over links between the given sets.

    With two sides only pairs across them count.  Shingles in few sets are counted pair by pair,
    those in many by products of indicator columns.
    """
    many, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(many), sizes)
    values = np.concatenate([*sets, np.empty(0, np.int64)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, int)
    spread = np.diff(np.append(starts, len(values)))
    same = np.zeros(many * many, np.int32)
    few = (spread > 1) & (spread <= RARE)
    at = np.repeat(starts[few], spread[few])
    place = np.arange(len(at)) - np.repeat(np.cumsum(spread[few]) - spread[few], spread[few]) + at
    end = at + np.repeat(spread[few], spread[few])
    for step in range(1, RARE):
        place, end = place[place + step < end], end[place + step < end]
        if not len(place):
            break
        same += np.bincount(owner[place] * many + owner[place + step], minlength=many * many).astype(np.int32)
    same = same.reshape(many, many)
    wide = np.flatnonzero(spread > RARE)
    for first in range(0, len(wide), 1024):
        some = wide[first : first + 1024]
        there = np.zeros((many, len(some)), np.float32)
        for column, group in enumerate(some):
            there[owner[starts[group] : starts[group] + spread[group]], column] = 1
        same += np.triu(there @ there.T, 1).astype(np.int32)
    close = same.astype(np.int64) * 100 >= percent * (sizes[:, None] + sizes[None, :] - same)
    close &= np.triu(np.ones((many, many), bool), 1)
    if len(np.unique(side)) > 1:
        close &= side[:, None] != side[None, :]
    return _least_members(many, *np.nonzero(close))


def close_sets(sizes: np.ndarray, bits: list[bytes], side: np.ndarray, percent: int) -> np.ndarray:
    """As ``linked_sets``, over pairs whose sketches do not rule out a link."""
    lengths, most = np.array([len(b) for b in bits], np.int64), 1 << (-(-100 // percent) - 1).bit_length()
    ones, twos = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    across = len(np.unique(side)) > 1
    for length in np.unique(lengths):  # smaller partners; larger ones are folded to this length
        here = np.flatnonzero((lengths >= length) & (lengths <= length * most))
        here = here[np.argsort(sizes[here], kind="stable")]
        size, own = sizes[here], int((lengths[here] == length).sum())
        end = np.searchsorted(size, size[own - 1] * 100 // percent, "right")
        here, size = here[:end], size[:end]
        folded = [np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint8).reshape(-1, length), axis=0) for i in here]
        signs = 1 - 2 * np.unpackbits(np.array(folded), axis=1).astype(np.float32)
        for at in range(0, own, SKETCH_ROWS):
            last = min(own, at + SKETCH_ROWS)
            end = np.searchsorted(size, size[last - 1] * 100 // percent, "right")
            differ = (8 * length - signs[at:last] @ signs[at:end].T) / 2
            close = differ * (100 + percent) <= (100 - percent) * (size[at:last, None] + size[None, at:end])
            if across:
                close &= side[here[at:last], None] != side[None, here[at:end]]
            one, two = np.nonzero(np.triu(close, 1))
            ones.append(here[at + one])
            twos.append(here[at + two])
    return _least_members(len(bits), np.concatenate(ones), np.concatenate(twos))


def _least_members(many: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    least = np.arange(many)
    while True:
        low = np.minimum(least[one], least[two])
        after = least.copy()
        np.minimum.at(after, one, low)
        np.minimum.at(after, two, low)
        after = after[after]
        if (after == least).all():
            return least
        least = after


def _forest(uid: np.ndarray, least: np.ndarray) -> pa.Table:
    moved = np.flatnonzero(least != np.arange(len(least)))
    return pa.table({"a": uid[least[moved]], "b": uid[moved]})


def _sketch_links(tasks: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """``a, b``: spanning forest of the possible links within every task of ``tasks(uid, i, j, side)``."""

    def run(table: pa.Table) -> pa.Table:
        uid, place = np.unique(table.column("uid").to_numpy(), return_index=True)
        sizes, sides = table.column("n").to_numpy()[place], table.column("side").to_numpy()[place]
        bits = table.column("bits").take(pa.array(place)).to_pylist()
        return _forest(uid, close_sets(sizes, bits, sides, percent))

    tasks = checkpointed(tasks, "tasks")
    rows = signed.select("uid", "n", "bits").join(checked_broadcast(tasks), "uid")
    return rows.groupBy("i", "j").applyInArrow(run, "a bigint, b bigint")


def _text_links(
    tasks: DataFrame, wanted: DataFrame, docs: DataFrame, words: int, percent: int, repeated: bool
) -> DataFrame:
    """``a, b``: spanning forest of the links within every task of ``tasks(uid, i, j, side)``.

    Texts travel to the tasks, which compress better than their hashes.  ``wanted`` has the id, the
    text's hash and the set's key of every row; ``repeated`` says that rows share both of the first.
    """

    def run(table: pa.Table) -> pa.Table:
        uids, sets, sides = [], [], []
        for batch in table.to_batches():
            columns = [batch.column(n).to_pylist() for n in ("uid", "k1", "k2", "side")]
            for uid, k1, k2, side, text in zip(*columns, texts_of(batch.column("text")), strict=True):
                hashes = shingle_hashes(words_of(text), words)
                if set_key(hashes) == (k1, k2):
                    uids.append(uid)
                    sets.append(hashes.view(np.int64))
                    sides.append(side)
        uid, place = np.unique(np.array(uids, np.int64), return_index=True)
        least = linked_sets([sets[i] for i in place], np.array(sides, np.int64)[place], percent)
        return _forest(uid, least)

    tasks = checkpointed(tasks.join(wanted.drop("n"), "uid"), "tasks").alias("tasks")
    rows = docs.alias("docs").join(checked_broadcast(tasks), _same_row("docs", "tasks"))
    rows = rows.select(*(f"tasks.{c}" for c in ("uid", "k1", "k2", "side", "i", "j")), F.col("docs.text").cast("string").alias("text"))
    if repeated:
        rows = rows.dropDuplicates(["uid", "i", "j"])
    return rows.groupBy("i", "j").applyInArrow(run, "a bigint, b bigint")


def _same_row(docs: str, known: str):
    """Rows of ``docs`` are told apart by id and text, whatever other columns they have."""
    same_id = F.col(f"{docs}.doc_id").cast("bigint").eqNullSafe(F.col(f"{known}.doc_id"))
    return same_id & (F.xxhash64(F.col(f"{docs}.text").cast("string")) == F.col(f"{known}.text_hash"))


def _cross_tasks(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tasks for ``pairs(a, i, j)``: the members of centre ``a`` in either block."""
    out = None
    for column, side in (("i", 0), ("j", 1)):
        some = members.join(pairs.withColumn("block", F.col(column)), ["a", "block"])
        some = some.select("uid", "i", "j", F.lit(side).alias("side"))
        out = some if out is None else out.union(some)
    return out.distinct()


def _candidate_links(ties: DataFrame, sizes: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``(a, b)`` that connect all linked sets among the candidates of ``ties(a, b)``.

    ``sizes(uid, n)`` has every tied set; ``compare`` gives the links within each of its tasks.
    """
    members = checkpointed(ties.select("a", F.col("b").alias("uid")).union(ties.select("a", "a")).distinct(), "members")
    up = members.select("a", F.col("a").alias("up")).distinct()
    for _ in range(ANCHOR_STEPS):  # the least centre, then the least centre of its centres, and so on
        anchors = members.join(up, "a").groupBy("uid").agg(F.min("up").alias("anchor"))
        anchors = checkpointed(anchors, "anchors")
        up = anchors.select(F.col("uid").alias("a"), F.col("anchor").alias("up"))
    cost = F.greatest("n", F.lit(LEAST_COST)).alias("cost")
    anchors = anchors.join(sizes, "uid").select("uid", "anchor", cost, F.lit(0).alias("all"))
    placed = prefix_sums(anchors, ["all"], ["anchor", "uid"], "cost", "placed")
    placed = checkpointed(placed.select("uid", F.floor(F.col("before") / BLOCK_COST).alias("block")), "blocks")
    itself = placed.select("uid", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"))
    members = members.join(placed, "uid")
    spans = members.groupBy("a", "block").agg(F.min("uid").alias("one"))
    first = spans.groupBy("a").agg(F.min("block").alias("first"), F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    spans = checkpointed(spans.join(first, "a").select("a", "block", "first", "blocks"), "spans")
    wide = checkpointed(spans.select(F.col("a").alias("of")).distinct(), "wide")
    members = checkpointed(members.join(checked_broadcast(wide), F.col("a") == F.col("of"), "left_semi"), "spanning")
    star = spans.where("block <> first").select("a", F.col("first").alias("i"), F.col("block").alias("j"))
    links = checkpointed(compare(itself.union(_cross_tasks(members, star))), "links")
    rest = spans.where("block <> first and blocks > 2").select("a", "block")
    if rest.isEmpty():
        return links
    parts = components(links, "parts").select(F.col("node").alias("uid"), "component")
    known = members.join(parts, "uid", "left").withColumn("part", F.coalesce("component", "uid"))
    known = known.groupBy("a", "block").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    known = checkpointed(known.join(rest, ["a", "block"]), "known")
    other = known.select("a", F.col("block").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    one = (F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2"))
    pairs = known.withColumnRenamed("block", "i").join(other, "a").where(F.col("i") < F.col("j")).where(~one)
    pairs = checkpointed(pairs.select("a", "i", "j"), "pairs")
    return checkpointed(links.union(compare(_cross_tasks(members, pairs))), "links")


def link_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, text_hash, part`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, ``class_id`` the smallest id with the
    same set.  ``part`` numbers the component, also where no row of it has an id.
    """
    signed = checkpointed(
        _signed_sets(docs, words, percent).withColumn("uid", F.monotonically_increasing_id()), "sets"
    )
    copies = checkpointed(
        signed.where("n > 0")
        .groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2"))
        .agg(
            F.min("uid").alias("first"),
            F.min("doc_id").alias("class_id"),
            F.count(F.lit(1)).alias("rows"),
        )
        .where("rows > 1")
        .drop("rows"),
        "copies",
    )
    classed = signed.join(
        checked_broadcast(copies), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") > 0), "left"
    ).withColumn("first", F.coalesce("first", "uid"))
    members = checkpointed(
        classed.select("doc_id", "text_hash", "n", "k1", "k2", "uid", "first", F.coalesce("class_id", "doc_id").alias("class_id")),
        "members",
    )
    sigs = _signatures(classed.where("uid = first"), 0)
    salt, thin = 0, [r[0] for r in signed.select(F.explode("thin").alias("band")).distinct().collect()]
    while thin:  # hardly ever: other ranges for the bands concerned, which number a few dozen at most
        salt += 1
        more = checkpointed(_signed_sets(docs, words, percent, salt, frozenset(thin)), "sets")
        own = members.where("uid = first").select("uid", F.col("k1").alias("c1"), F.col("k2").alias("c2"))
        same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
        sigs = sigs.union(_signatures(more.dropDuplicates(["k1", "k2"]).join(own, same), salt))
        thin = [r[0] for r in more.select(F.explode("thin").alias("band")).distinct().collect()]
    sigs = checkpointed(_rarest(sigs), "kept")
    met = checkpointed(
        sigs.groupBy("sig")
        .agg(F.min("uid").alias("a"), F.max("uid").alias("b"), F.count(F.lit(1)).alias("n"))
        .where("a < b"),
        "met",
    )
    larger = checkpointed(met.where("n > 2").select(F.col("sig").alias("of"), "a"), "larger")
    ties = met.where("n = 2").select("a", "b").union(
        sigs.join(checked_broadcast(larger, 1 << 21), F.col("sig") == F.col("of"))
        .where("uid <> a")
        .select("a", F.col("uid").alias("b"))
    )
    ties = checkpointed(ties.distinct(), "ties")
    parts = None
    if not ties.isEmpty():
        tied = checkpointed(ties.select(F.col("a").alias("uid")).union(ties.select("b")).distinct(), "tied")
        sizes = checkpointed(members.select("uid", "n").join(checked_broadcast(tied), "uid"), "sizes")
        parts = components(_candidate_links(ties, sizes, lambda t: _sketch_links(t, signed, percent)), "possible")
        ties = checkpointed(parts.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")), "ties")
    if not ties.isEmpty():
        wanted = checkpointed(parts.select(F.col("node").alias("uid")), "wanted")
        wanted = members.join(checked_broadcast(wanted), "uid")
        wanted = checkpointed(wanted.select("uid", "doc_id", "text_hash", "k1", "k2", "n"), "wanted")
        repeated = not members.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
        links = _candidate_links(ties, wanted.select("uid", "n"), lambda t: _text_links(t, wanted, docs, words, percent, repeated))
        parts = components(links, "parts")
    if parts is None:
        return members.select(
            "doc_id", F.col("n").alias("n_shingles"), F.col("class_id").alias("component_id"), "class_id",
            "text_hash", F.col("first").alias("part"),
        )
    first = members.where("uid = first").select("uid", "class_id")
    known = parts.join(first, F.col("node") == F.col("uid"))
    least = known.groupBy("component").agg(F.min("class_id").alias("component_id"))
    map_to = checkpointed(
        known.select(F.col("uid").alias("first"), "component").join(least, "component").select("first", "component_id", "component"), "map"
    )
    return members.join(checked_broadcast(map_to), "first", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "class_id").alias("component_id"),
        "class_id",
        "text_hash",
        F.coalesce("component", "first").alias("part"),
    )


def one_of_each_group(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, keep_null_ids: bool = True
) -> DataFrame:
    """Rows of ``docs``, of every group of linked ones only the first by id, then by hash of the text.

    Rows without an id stay; without ``keep_null_ids`` they are compared like any other and come last
    in their groups.  Rows go by id and text: other texts under a dropped row's id stay, and of rows
    equal in both one stays.  Rows without words stay.  Other columns are kept, whatever their names.
    """
    groups = link_groups(docs, words, percent).where("n_shingles > 0")
    groups = checkpointed(groups.where("doc_id is not null") if keep_null_ids else groups, "groups")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    several = groups.groupBy(F.col("part").alias("of")).agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("rows"))
    several = checkpointed(several.where("rows > 1"), "several")
    known = groups.join(checked_broadcast(several), F.col("part") == F.col("of"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash"))
    rows = known.groupBy("doc_id", "text_hash").agg(F.max(kept).alias("kept"), F.count(F.lit(1)).alias("rows"))
    rows = checkpointed(rows.where("not kept or rows > 1"), "rows")
    drop = checked_broadcast(checkpointed(rows.where("not kept"), "drop")).alias("gone")
    rest = docs.alias("docs").join(drop, _same_row("docs", "gone"), "left_anti")
    twice = checkpointed(rows.where("kept"), "twice")
    if twice.isEmpty():
        return rest
    twice = checked_broadcast(twice).alias("twice")
    again = rest.alias("docs").join(twice, _same_row("docs", "twice"), "left_semi")
    single = rest.alias("docs").join(twice, _same_row("docs", "twice"), "left_anti")
    return single.unionByName(again.dropDuplicates(["doc_id", "text"]))
