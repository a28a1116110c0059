"""Centroid clustering, SimHash and phrase mining against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiframe.llm import centroids, phrases, simhash

VECTORS = "vec_id long, embedding array<float>, v string, cluster int"
DOCS = "doc_id long, text string"
TEXTS = "doc_id long, text string, lang string"

# ---------------------------------------------------------------- centroids


def plain_clusters(rows, width, clusters, rounds):
    kept = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    middle = [v for _, v in sorted(kept, key=lambda r: (key(r), r[1]))[:clusters]]

    def near(v):
        found = [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in middle]
        return min(range(len(found)), key=lambda i: (found[i], i)), min(found)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[0], []).append(v)
        middle = [[sum(x) // len(x) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(middle)]
    placed = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, c, d in placed:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in placed), key=str)


def clustered(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    return sorted((tuple(r) for r in centroids.cluster(df, **how).collect()), key=str)


def test_clusters_equal_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (None, rows[10][1])] + [(1000 + i, [0.5, 0.5, -0.5, 0.0]) for i in range(200)]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [math.nan] * 4), (905, [math.inf, 0.0, 0.0, 0.0])]
    want = plain_clusters(rows, 4, 6, 3)
    assert clustered(spark, rows, clusters=6, rounds=3, width=4) == want
    assert len(want) == 503 and len({r[1] for r in want}) > 3


def test_few_or_no_vectors(spark):
    rows = [(1, [0.25, 1.0]), (2, [0.25, 1.0]), (3, [-1e5, 2e6])]
    assert clustered(spark, rows, clusters=16, width=2) == plain_clusters(rows, 2, 16, 3)
    assert clustered(spark, [(1, None)], width=2) == []
    assert clustered(spark, [], width=2) == []
    assert clustered(spark, [(1, [1.0, 1e30])], width=2) == []  # no 64-bit distance


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(50, [9.0, 9.0])]
    assert clustered(spark, rows, clusters=8, width=2) == plain_clusters(rows, 2, 8, 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 27), 1 << 27), min_size=2, max_size=2), min_size=1, max_size=20),
       st.lists(st.lists(st.integers(-(1 << 27), 1 << 27), min_size=2, max_size=2), min_size=1, max_size=5))
def test_table_distances_are_exact(values, middle):
    cluster, distance = centroids.nearest(np.array(values, np.int64), np.array(middle, np.int64))
    for v, c, d in zip(values, cluster.tolist(), distance.tolist(), strict=True):
        all_of = [sum((x - y) ** 2 for x, y in zip(v, m, strict=True)) for m in middle]
        assert d == min(all_of) and c == all_of.index(d)


# ---------------------------------------------------------------- SimHash


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(keyed):
    """``(id, fingerprint, component)`` by comparing all pairs."""
    root = list(range(len(keyed)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keyed)):
        for j in range(i):
            if (keyed[i][1] ^ keyed[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(keyed):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(keyed)), key=str)


def near_rows(rng, many=60):
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 5)))
    rows = []
    for i in range(many):
        text = [word() for _ in range(rng.choice([1, 2, 3, 8, 80, 400]))]
        for c in range(rng.choice([1, 1, 3])):
            rows.append((i * 10 + c, " ".join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = word()
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "oNE"), (9003, "one"), (None, "one")]
    return rows


@pytest.mark.parametrize("heavy", [0, 2, 64])
def test_simhash_groups_equal_all_pairs(spark, heavy):
    rows = near_rows(random.Random(heavy))
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as fp", "1 as key", "2 as component")
    got = simhash.near_duplicates(df, heavy=heavy).collect()
    want = plain_groups([(d, plain_fingerprint(t)) for d, t in rows])
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(d is not None and c < d for d, _, c in want)


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


@pytest.mark.parametrize("heavy", [1, 64])
def test_links_of_crowded_and_sparse_segments(spark, heavy):
    """Families that share a segment, chains of single bits and random fingerprints, bit 31, 32 and 63 included."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    base, other = rng.getrandbits(64), rng.getrandbits(64)
    fps |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    fps |= {other & 0xFFFFFFFF | rng.getrandbits(32) << 32 for _ in range(100)}  # one first segment, far apart
    fps |= {0, 1 << 63, 1 << 63 | 1 << 31, 1 << 32, 0xFFFFFFFFFFFFFFFF, 0xFFFFFFFF7FFFFFFF}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.linked_fingerprints(df, heavy).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    assert parts_of(fps, links) == parts_of(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])


def parts_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_family_of_near_copies_costs_rows_in_proportion(spark):
    """A thousand fingerprints with one segment: no pairs are formed."""
    rng = random.Random(8)
    fps = list({0x12345678 | rng.getrandbits(10) << 40 for _ in range(3000)})
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = simhash.linked_fingerprints(df)
    assert links.count() <= 65 * len(fps) < len(fps) ** 2 // 8
    assert len(set(parts_of(fps, [(r.a, r.b) for r in links.collect()]).values())) == 1


def test_long_text_and_empty_table(spark):
    text = " ".join(f"w{i % 977}" for i in range(40_000))
    assert simhash.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


# ---------------------------------------------------------------- phrases


def plain_phrases(rows, least, longest, top, percent=100):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    scored = {}
    for (lang, p), a in f.items():
        if len(p) > 1:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)

    def inside(lang, p):
        return any(
            o[0] == lang and len(o[1]) > len(p) and 100 * v[0] >= percent * scored[lang, p][0]
            and any(o[1][i : i + len(p)] == p for i in range(len(o[1]) - len(p) + 1))
            for o, v in scored.items()
        )

    out = []
    for lang in sorted(n):
        kept = [(" ".join(p), v) for (x, p), v in scored.items() if x == lang and not inside(lang, p)]
        kept.sort(key=lambda r: (-r[1][4], -r[1][0], r[0].encode()))
        out += [(lang, i + 1, p, *v) for i, (p, v) in enumerate(kept[:top])]
    return out


def phrase_rows(seed, many=250):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ünder", "é", "a", "b", "New", "york", "city", "x\x00y", "q z", "ß"]
    weights = [8, 6, 1, 2, 5, 5, 2, 2, 2, 1, 1, 1]
    fixed = ["new york city hall of", "a a a a a a", "of the the of"]
    rows = []
    for i in range(many):
        w = rng.choices(vocabulary, weights, k=rng.choice([0, 1, 4, 30]))
        if rng.random() < 0.3:
            w.append(rng.choice(fixed))
        text = "".join(x + rng.choice([" ", "  ", "\t", ", ", ". ", "\n", " ", " ", " "]) for x in w)
        rows.append((i % 50, text, rng.choice(["en", "de", "", None])))
    rows += [(None, None, "en"), (None, "", None), (1, "!?", "xx"), (2, "new york city hall of", "en")]
    return rows + [(3, "new york city. the of", "fr")] * 40


@pytest.mark.parametrize("seed,shards,slots", [(1, 3, 1 << 23), (3, 4, 1), (4, 2, 512), (6, 1, 1024)])
def test_phrases_equal_plain_python(spark, seed, shards, slots):
    """Few slots make phrases start together; counts stay exact."""
    rows = phrase_rows(seed) + [(9, f"x{n} " * 13, "en") for n in range(60)]  # each within one shard
    df = spark.createDataFrame(rows, TEXTS).selectExpr("*", "'x' as phrase", "1 as slot", "2 as shard", "3 as count").repartition(5)
    got = phrases.collocations(df, top=25, least=12, shards=shards, slots=slots)
    want = plain_phrases(rows, 12, 5, 25)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_chunks_do_not_change_counts(spark, monkeypatch):
    rows = phrase_rows(4, 60)
    df = spark.createDataFrame(rows, TEXTS).coalesce(1)
    whole = sorted(map(tuple, phrases.frequent_phrases(df, least=5).collect()))
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 200)
    monkeypatch.setattr(phrases, "CHUNK_LANGS", 2)
    monkeypatch.setattr(phrases, "HELD_ROWS", 20)
    assert sorted(map(tuple, phrases.frequent_phrases(df, least=5).collect())) == whole


def test_partial_containment(spark):
    rows = [(i, "a b c" if i % 3 else "a b", "en") for i in range(60)]
    found = phrases.cut_scores(phrases.frequent_phrases(spark.createDataFrame(rows, TEXTS), least=5))
    assert {r.phrase for r in phrases.without_parts(found).collect()} == {"a b", "a b c"}
    assert {r.phrase for r in phrases.without_parts(found, percent=60).collect()} == {"a b c"}


def test_scores_past_64_bits(spark):
    rows = [("en", "", 0, 9 * 10**12), ("en", "a", 1, 10**12), ("en", "b", 1, 7 * 10**11), ("en", "a b", 2, 123456789012)]
    r = phrases.cut_scores(spark.createDataFrame(rows, "lang string, phrase string, words int, count long")).first()
    assert r.score == 1000 * 123456789012 * 9 * 10**12 // (10**12 * 7 * 10**11)


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], TEXTS)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "a b", "en"), (2, None, None)], TEXTS)).collect() == []
