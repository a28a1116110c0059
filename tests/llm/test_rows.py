"""Filtering operators go by rows: shared and null ids, equal rows, and columns named like their own."""

import collections

import numpy as np
from pyspark.sql import functions as F

from lexiframe.llm import decontaminate, mixing, partenum, quality, sharding

CLASHING = ("__id", "__source", "__copies", "__copy", "part", "of", "keep", "rows", "kept", "row", "copy", "shard", "slot", "turn")
A = " ".join(f"a{i}" for i in range(40))
B = " ".join(f"b{i}" for i in range(40))
C = " ".join(f"c{i}" for i in range(40))


def table(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("own") for c in CLASHING + ("text_hash", "component", "__crc", "__place")})


def counted(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_groups_lose_rows_not_ids(spark):
    rows = [(3, A), (5, A), (5, B), (None, A), (None, A), (None, C), (None, C + " more"), (8, None), (8, ""), (9, B + " x"), (5, B)]
    df = table(spark, rows)
    out = partenum.one_of_each_group(df, 5, 80, keep_null_ids=False)
    assert out.columns == df.columns
    found = counted(out, "doc_id", "text")
    assert found[(3, A)] == found[(5, B)] == found[(8, None)] == found[(8, "")] == 1
    assert found[(None, C)] + found[(None, C + " more")] == 1 and sum(found.values()) == 5
    assert all(r["__id"] == r["keep"] == "own" for r in out.collect())


def test_rarest_signatures_are_shared_in_any_order():
    """Linked pairs share a signature that both keep, whatever order the table gives the signatures."""
    rng = np.random.default_rng(1)
    for percent in (60, 80, 85):
        signer = partenum.Signer(percent, 0, None)
        for size in [*range(2, 60), 100, 257, 1000]:
            for _ in range(5):
                other = int(rng.integers(-(-size * percent // 100), size + 1))
                same = -(-percent * (size + other) // (100 + percent))
                if same > other or size == other == same:
                    continue
                pool = rng.integers(0, 1 << 63, size + other - same, dtype=np.uint64) * np.uint64(2)
                signed = [signer.runs(np.sort(pool[:size])), signer.runs(np.sort(pool[size - same :]))]
                if any(thin for _, thin in signed):
                    continue
                order = {s: (rng.integers(1, 4), s) for runs, _ in signed for _, own in runs for s in own.tolist()}
                kept = [
                    {s for need, own in runs for s in sorted(own.tolist(), key=order.get)[:need]} for runs, _ in signed
                ]
                assert kept[0] & kept[1]


def test_documents_that_share_a_passage_are_not_tied(spark):
    """Ties grow with the rows, not with the pairs that share a passage; near copies are tied."""
    passage, rng = " ".join(f"p{i}" for i in range(30)), np.random.default_rng(3)
    rows = [(i, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 60))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = partenum._signed_sets(df, 5, 80).withColumn("uid", F.col("doc_id"))
    kept = partenum._rarest(partenum._signatures(signed, 0))
    assert {r["uid"] for r in kept.collect()} == {*range(10), *range(300, 310)}
    out = {r["doc_id"]: r["component_id"] for r in partenum.link_groups(df, 5, 80).collect()}
    assert out == {i: i - 300 if i >= 300 else i for i in range(310)}


def test_leaks_lose_rows_not_ids(spark):
    items = spark.createDataFrame([(1, A + ".")], "item_id long, text string")
    rows = [(1, A + "."), (1, B), (None, "x " + A + "."), (None, C), (2, None), (1, A + ".")]
    df = table(spark, rows)
    out = decontaminate.without_leaks(df, items, keep_null_ids=False)
    assert out.columns == df.columns
    assert counted(out, "doc_id", "text") == {(1, B): 1, (None, C): 1, (2, None): 1}


def test_mix_repeats_rows_not_ids(spark):
    rows = [(None, " ".join([f"n{i}"] * 10), "a") for i in range(50)] + [(7, "same " * 10, "a")] * 20
    rows += [(100 + i, "w " * 10, "b") for i in range(10)] + [(1, None, "b"), (1, "", None)]
    schema = "doc_id long, text string, source string"
    df = table(spark, rows, schema)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    plan = mixing.mix(df).where("taken > 0").collect()
    want = collections.Counter()
    for r in plan:
        want[r["source"]] += -(-r["taken"] // r["size"])
    assert counted(out, "source") == {(s,): n for s, n in want.items()}
    targets = {r["source"]: r["target"] for r in plan}
    for (source,), many in counted(out, "source").items():
        assert abs(10 * many - targets[source]) <= 10


def test_written_shards_hold_equal_rows_apart(spark, tmp_path):
    rows = [(1, A, "s", "en", 1)] * 25 + [(None, B, "s", "de", 1)] * 25 + [(i, f"t{i}", "s", None, 2) for i in range(10)]
    df = table(spark, rows, "doc_id long, text string, source string, lang string, n_chars long")
    path = str(tmp_path / "shards")
    manifest = {r["shard"]: r["rows"] for r in sharding.write_shards(df, path, shards=7).collect()}
    assert sum(manifest.values()) == 60 and max(manifest.values()) - min(manifest.values()) <= 1
    written = spark.read.parquet(path)
    assert counted(written, "doc_id", "text") == counted(df, "doc_id", "text")
    assert set(written.columns) == set(df.columns)


def test_shapes_are_of_whole_words():
    same = "ab" * 200
    assert quality.word_shape((same + "1").encode()) != quality.word_shape((same + "!").encode())
    assert quality.word_shape(("aB" * 30).encode()) == "aA" * 30


def test_signatures_are_shuffled_once_at_any_size(spark):
    """Their count sends no second copy of them, and the plan does not depend on how many there are."""
    rows = [(uid, run, spare, sig) for uid in range(40) for run, spare in ((0, -3), (1, 0)) for sig in range(run, 50, 1 + uid % 7)]
    sigs = spark.createDataFrame(rows, "uid long, run int, spare int, sig long")
    kept = partenum._rarest(sigs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(sig#") == 1
    sets = collections.Counter(sig for *_, sig in rows)
    want = set()
    for uid in range(40):
        for run, spare in ((0, -3), (1, 0)):
            own = sorted((sets[s], s) for u, r, _, s in rows if (u, r) == (uid, run))
            alone = sum(n == 1 for n, _ in own)
            want |= {(uid, s) for _, s in [x for x in own if x[0] > 1][: max(0, len(own) + spare - alone)]}
    assert {tuple(r) for r in kept.collect()} == want
