"""Mixing and sharding against plain Python on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiframe.llm import mixing, sharding
from lexiframe.llm.common import components, prefix_sums

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets of ``{source: size}``; repeated sharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        now = {s for s in names if s in full or most * sizes[s] <= left * weight[s] / open_weight}
        if now == full or len(now) == len(names):
            return {s: most * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        full = now


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("abé", max_size=3)), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_share_everything(sizes):
    targets = plain_targets(sizes)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert all(t <= 3 * sizes[s] + 1e-6 for s, t in targets.items())


ROWS = [
    (1, "a b c d e", "en", "a", 9),
    (2, "a b", "en", "a", 3),
    (3, None, "en", "a", None),
    (4, "", None, "b", 0),
    (5, "x " * 300, "en", "big", 600),
    (6, "x y z", "en", None, 5),
    (6, "x y z", "en", None, 5),
    (None, "one two", None, "b", 7),
    (8, "q r s", "fr", "é", 5),
    (9, "t", "fr", "big", 1),
]


def test_mix_takes_each_target(spark):
    rows = mixing.mix(spark.createDataFrame(ROWS, DOCS)).collect()
    assert len(rows) == len(ROWS)
    sizes = {}
    for _, text, _, source, _ in ROWS:
        sizes[source] = sizes.get(source, 0) + words(text)
    targets = plain_targets(sizes)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, target in targets.items():
        assert taken[source] == round(target)


def test_mix_goes_by_hash_order(spark):
    docs = [(i, "w " * (i % 7 + 1), "en", "big" if i % 3 else "small", 0) for i in range(200)]
    rows = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(docs, DOCS)).collect()}
    for source in ("big", "small"):
        mine = sorted((i for i in rows if rows[i]["source"] == source), key=lambda i: hashlib.md5(f"mix/{i}".encode()).hexdigest())
        budget = round(rows[mine[0]]["target"])
        epochs, rest = divmod(budget, rows[mine[0]]["source_size"])
        for i in mine:
            extra = max(0, min(rows[i]["size"], rest))
            rest -= rows[i]["size"]
            assert rows[i]["taken"] == epochs * rows[i]["size"] + extra


def test_mix_reruns_agree_and_empty_tables_are_fine(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    first = sorted(map(str, mixing.mix(docs).collect()))
    assert first == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


def test_mixed_documents_repeat_what_is_taken(spark):
    docs = spark.createDataFrame([r for i, r in enumerate(ROWS) if i != 6], DOCS)
    taken = {(r["doc_id"], r["source"]): (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    count = {}
    for r in out.collect():
        count[r["doc_id"], r["source"]] = count.get((r["doc_id"], r["source"]), 0) + 1
    assert count == {k: -(-t // s) for k, (t, s) in taken.items() if t}


def test_prefix_sums_over_one_hot_group(spark):
    rows = [("hot" if i % 4 else "cold", i // 3, i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    got = prefix_sums(df, ["g"], ["k", "v"], "v", "test").collect()
    for g in ("hot", "cold"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: (r["k"], r["v"], r["before"]))
        total = 0
        for r in mine:
            assert r["before"] == total
            total += r["v"]
    assert len(got) == 3000


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (200, 2))] + [(1000, i) for i in range(1001, 1300)]
    edges += [(i, i + 1) for i in range(2000, 2060)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {n for a, b in edges if a != b for n in (a, b)}}


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 4)])
def test_hilbert_curve_visits_every_cell_in_unit_steps(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(side**dims))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards_are_level_gapless_and_true_to_the_text(spark):
    docs = [(i, None if i % 50 == 0 else "téxt " * (i % 40), "en", f"s{i % 9}", i) for i in range(500)]
    docs += [(7, "again", None, None, None)] * 3 + [(None, "", "fr", "s1", 0)]
    rows = sharding.shard(spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(docs)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(by_shard) == list(range(40))
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in docs)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in rows)


def test_fewer_rows_than_shards_and_none(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(5)], DOCS)
    rows = sharding.shard(docs).collect()
    assert sorted(r["slot"] for r in rows) == [0] * 5 and all(0 <= r["shard"] < 40 for r in rows)
    assert sharding.shard(docs.limit(0)).collect() == []


def test_written_shards_can_be_pruned(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * (i % 60), "en", f"s{i % 5}", i % 60 * 2) for i in range(400)], DOCS)
    manifest = sharding.write_shards(docs, str(tmp_path / "shards"), shards=20)
    assert manifest.agg({"rows": "sum"}).first()[0] == 400
    hit = [r["shard"] for r in sharding.shards_to_read(manifest, source="s2", n_chars=10).collect()]
    back = spark.read.parquet(str(tmp_path / "shards")).where("source = 's2' and n_chars = 10")
    assert {r["shard"] for r in back.collect()} <= set(hit) and len(hit) < 20


def test_targets_of_sizes_beyond_32_and_64_bits(spark):
    for unit in (10**9, 10**15, 10**18):  # an int overflows as weight times words, a long as cap times weight
        sizes = {"a": unit // 100, "b": unit // 3, "c": unit // 2, None: unit // 7}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: (r.weight, r.target) for r in mixing.source_targets(frame).collect()}
        targets = plain_targets(sizes)
        assert {s: w for s, (w, _) in found.items()} == {"a": 1, "b": 2, "c": 3, None: 1}
        assert all(t == pytest.approx(targets[s], rel=1e-12) for s, (_, t) in found.items())


def test_documents_of_a_mix_beyond_32_bits(spark, monkeypatch):
    rows = [r for r in ROWS if r[0] is not None and r[0] != 6]
    frame = spark.createDataFrame(rows, DOCS)
    small = sorted(r.doc_id for r in mixing.mixed_documents(frame).collect())
    count = mixing.word_count
    monkeypatch.setattr(mixing, "word_count", lambda text: count(text) * 3_000_000)  # 927 million words, shared alike
    assert sorted(r.doc_id for r in mixing.mixed_documents(frame).collect()) == small
