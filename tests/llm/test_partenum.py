"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from lexiframe.llm import partenum
from lexiframe.llm.words import shingle_hashes, words_of

DOCS = "doc_id long, text string"


def shingles(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute_force(rows, width, percent):
    """``(doc_id, n, component)`` per row; components over links between all pairs."""
    sets = [shingles(text, width) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if same * 100 >= percent * (len(sets[i]) + len(sets[j]) - same):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(
        ((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str
    )


def joined(spark, rows, width, percent):
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as sigs", "1 as uid", "2 as n")
    got = partenum.link_groups(df, width, percent).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


def corpus(seed, texts=60, copies=5):
    """Texts of many sizes with chains of edits, exact copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(2, 4)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(texts):
        words = [word() for _ in range(rng.choice([1, 2, 4, 8, 12, 20, 30, 60, 120, 300]))]
        if rng.random() < 0.4:
            words[len(words) // 2 : len(words) // 2] = passage
        out.append(words)
        for _ in range(rng.randint(0, copies)):
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [word()]
            out.append(words)
    rng.shuffle(out)
    return [(i, rng.choice([" ", "\n", "\t "]).join(w).title()) for i, w in enumerate(out)]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (3, 3, 60)])
def test_join_equals_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    assert joined(spark, rows, width, percent) == brute_force(rows, width, percent)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one\ttwo three"),
        (8, long), (9, long + " more"), (10, "É é"), (11, "é é"), (12, "a b c d e"), (13, "a b c d e"),
        (None, "a b c d e"), (13, "a b c d e"), (14, None), (None, None), (15, "x x x x x x x x"), (16, "x x x x"),
    ]
    assert joined(spark, rows, 4, 85) == brute_force(rows, 4, 85)
    assert joined(spark, rows[:0], 4, 85) == []
    assert joined(spark, rows[:3], 4, 85) == brute_force(rows[:3], 4, 85)


@pytest.mark.parametrize("cost", [1 << 19, 600])
def test_a_chain_and_a_large_group_stay_whole(spark, monkeypatch, cost):
    """Neighbours of a chain are linked, its ends are not; a star of near copies has one component."""
    monkeypatch.setattr(partenum, "BLOCK_COST", cost)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    chain, words = [], list(base)
    for step in range(40):
        words = list(words)
        words[(step * 9) % 100] = f"c{step}"
        chain.append(" ".join(words))
    star = []
    for i in range(150):
        words = [f"s{j}" for j in range(120)]
        words[rng.randrange(120)] = f"t{i}"
        star.append(" ".join(words))
    rows = list(enumerate(chain + star + [star[0]] * 50))
    assert joined(spark, rows, 4, 85) == brute_force(rows, 4, 85)


def test_pairs_share_signatures():
    """Every pair at the similarity has a signature in common, for all sizes and the least overlap."""
    rng = np.random.default_rng(1)
    for percent in (60, 80, 85):
        signer = partenum.Signer(percent, 0, None)
        for size in [*range(2, 60), 100, 257, 1000]:
            for _ in range(10):
                other = int(rng.integers(-(-size * percent // 100), size + 1))
                same = -(-percent * (size + other) // (100 + percent))
                if same > other or 100 * same < percent * (size + other - same):
                    continue
                pool = rng.integers(0, 1 << 63, size + other - same, dtype=np.uint64) * np.uint64(2)
                one, two = np.sort(pool[:size]), np.sort(pool[size - same :])
                if len(np.unique(pool)) < len(pool) or (size == other == same):
                    continue
                (a, thin_a), (b, thin_b) = signer.sign(one), signer.sign(two)
                assert thin_a or thin_b or np.intersect1d(a, b).size


def test_bands_sign_again_when_ranges_are_too_few(spark, monkeypatch):
    """With hardly any ranges sets stay thin at first; the repeated bands make up for it."""
    real = partenum.ranges_of
    monkeypatch.setattr(partenum, "ranges_of", lambda percent, high: max(3, real(percent, high) // 6) if high < 10 else real(percent, high))
    rows = corpus(7, texts=40)
    assert joined(spark, rows, 4, 85) == brute_force(rows, 4, 85)


def test_one_of_each_group_stays(spark):
    rows = corpus(9, texts=30)
    rows += [(500, None), (501, ""), (None, rows[0][1])]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'en' as lang")
    kept = [r["doc_id"] for r in partenum.one_of_each_group(df, 5, 80).collect()]
    want = [doc for doc, _, component in brute_force(rows, 5, 80) if doc == component or not doc]
    assert sorted(map(str, kept)) == sorted(map(str, want + ([500, 501] if 500 not in want else [])))
    assert partenum.one_of_each_group(df, 5, 80).columns == df.columns
    again = df.where("doc_id < 3").union(df.where("doc_id < 3"))
    ids = [r["doc_id"] for r in partenum.one_of_each_group(again, 5, 80).collect()]
    assert len(ids) == len(set(ids))


def test_hashes_are_of_sets_of_runs():
    words = words_of(b"a b a b a b")
    assert len(shingle_hashes(words, 2)) == 2 and len(shingle_hashes(words, 9)) == 1
    assert len(shingle_hashes([], 4)) == 0
    assert (shingle_hashes(words_of("Ü x".encode()), 4) != shingle_hashes(words_of("ü x".encode()), 4)).all()


def test_sketches_rule_out_no_link():
    """Every linked pair is a possible link, folded or not; sets without common shingles are not."""
    rng = np.random.default_rng(2)
    for percent in (40, 60, 80, 85):
        for size in [1, 2, 3, 5, 9, 31, 33, 60, 64, 65, 100, 257, 1000]:
            for other in {size, -(-size * percent // 100), size * 9 // 10 + 1}:
                same = -(-percent * (size + other) // (100 + percent))
                if same > min(size, other):
                    continue
                pool = rng.integers(0, 1 << 63, size + other - same, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                sets = [pool[:size], pool[size - same :]]
                bits, sizes = [partenum.parity_sketch(s) for s in sets], np.array([size, other])
                assert partenum.close_sets(sizes, bits, np.zeros(2, int), percent).tolist() == [0, 0]
                assert partenum.close_sets(sizes, bits, np.arange(2), percent).tolist() == [0, 0]
    apart = [rng.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(50)]
    bits = [partenum.parity_sketch(s) for s in apart]
    assert partenum.close_sets(np.full(50, 200), bits, np.zeros(50, int), 80).tolist() == list(range(50))
