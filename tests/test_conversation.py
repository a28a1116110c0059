"""Sessions, history windows, prompts and request checks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.operators import conversation as ops

T0 = dt.datetime(2024, 1, 1, 12)
DAY = dt.timedelta(hours=24)
US = dt.timedelta(microseconds=1)


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id int, ts timestamp_ntz")


def test_gap_of_exactly_the_ttl_stays_one_more_microsecond_opens(spark):
    df = events(spark, [(1, T0), (1, T0 + DAY), (2, T0), (2, T0 + DAY + US)])
    got = {(r.conv_id, r.session_no): r.messages for r in ops.sessionize(df).collect()}
    assert got == {(1, 1): 2, (2, 1): 1, (2, 2): 1}


def test_random_sessions(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(40):
        at = T0
        for _ in range(rng.randint(1, 60)):
            at += dt.timedelta(seconds=rng.choice([5, 4000, 80_000, 86_400, 86_401, 500_000]))
            rows.append((conv, at))
    want = {}
    for conv, at in rows:
        mine = want.setdefault(conv, [])
        if not mine or at > mine[-1][-1] + DAY:
            mine.append([])
        mine[-1].append(at)
    got = {}
    for r in ops.sessionize(events(spark, rows)).orderBy("session_no").collect():
        got.setdefault(r.conv_id, []).append((r.created_at, r.updated_at, r.messages))
    epoch = dt.datetime(1970, 1, 1)
    us = lambda t: (t - epoch) // US
    assert got == {c: [(us(s[0]), us(s[-1]), len(s)) for s in v] for c, v in want.items()}
    labels = ops.label_sessions(events(spark, rows))
    assert labels.count() == len(rows)
    assert labels.select("session_id").distinct().count() == sum(map(len, want.values()))


def test_expiry_is_strict(spark):
    df = events(spark, [(1, T0), (2, T0 - US)])
    asof = F.lit(int((T0 + DAY - dt.datetime(1970, 1, 1)) / US))
    assert [r.conv_id for r in ops.expired_sessions(df, asof).collect()] == [2]


def test_history_across_blocks_and_gaps(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(6):
        turn = 0
        for _ in range(rng.choice([1, 5, 40])):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), "x" * rng.choice([3, 500, 501])))
            turn += rng.choice([1, 1, 2, 9])
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4)
    want = {}
    for conv in {r[0] for r in rows}:
        lines = []
        for c, turn, role, text in sorted(r for r in rows if r[0] == conv):
            want[(c, turn)] = "\n".join(lines[-10:][-6:])
            label = "Pengguna" if role == "user" else "Asisten"
            lines.append(f"{label}: {text[:500] + '...' if len(text) > 500 else text}")
    for size in (4096, 7):
        got = {(r.conv_id, r.turn): r.history for r in ops.history_window(df, size).collect()}
        assert got == want


def test_prompt_and_empty_retrieval(spark):
    questions = spark.createDataFrame(
        [(1, "apa?", "Pengguna: halo"), (2, "apa?", ""), (3, "apa?", "")],
        "query_id int, message string, history string",
    )
    results = spark.createDataFrame(
        [(1, 2, 5, None, "elucidation", "dua"), (1, 1, 106, 4, "body", "satu"), (2, 1, None, 0, "body", "t")],
        "query_id int, rank int, article_number int, paragraph_number int, chunk_type string, text string",
    )
    got = {r.query_id: r for r in ops.prompt_table(questions, ops.format_context(results)).collect()}
    assert got[1].prompt == (
        "KUTIPAN DOKUMEN HUKUM LALU LINTAS:\n[1] Pasal 106 ayat (4) (Isi):\nsatu\n\n"
        "[2] Pasal 5 (Penjelasan):\ndua\n\n\nRIWAYAT PERCAKAPAN:\nPengguna: halo\n\n"
        "PERTANYAAN PENGGUNA:\napa?\n\n" + fixed.PROMPT_CLOSING
    )
    assert "RIWAYAT" not in got[2].prompt and "[1] Pasal ? (Isi):\nt" in got[2].prompt
    assert got[3].prompt is None and got[3].answer == fixed.NO_RELEVANT_CHUNKS


def test_failed_turns_and_suppressed_sources(spark):
    turns = spark.createDataFrame(
        [(1, "error", "r", ["c"]), (2, "ok", fixed.NOT_FOUND, ["c"]), (3, "ok", "r", ["c"])],
        "turn int, status string, response string, chunks array<string>",
    )
    log = {r.turn: (r.response, r.chunks) for r in ops.turn_log(turns).collect()}
    assert log[1] == (fixed.PROCESSING_ERROR, []) and log[2][1] == ["c"]  # stored history keeps them
    shown = {r.turn: r.chunks for r in ops.suppress_sources(ops.turn_log(turns)).collect()}
    assert shown == {1: [], 2: [], 3: ["c"]}


def test_request_bounds(spark):
    rows = [
        ("  hi ", None, None, True), ("x" * 2000, 20, 1.0, True), ("x" * 2001, 5, 0.3, False),
        ("a", 0, 0.3, False), ("a", 21, 0.3, False), ("a", 1, -0.1, False), (" \n", 5, 0.3, None),
    ]
    df = spark.createDataFrame(
        [(i, *r[:3]) for i, r in enumerate(rows)],
        "query_id int, message string, top_k int, min_similarity double",
    )
    got = {r.query_id: r for r in ops.validate_requests(df).collect()}
    assert {i: got[i].is_valid if i in got else None for i in range(7)} == {
        i: r[3] for i, r in enumerate(rows)
    }
    assert (got[0].message, got[0].top_k, got[0].min_similarity) == ("hi", 5, 0.3)


def test_deletion(spark):
    messages = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b")], "conv_id int, turn int, role string, text string")
    requests = spark.createDataFrame([(2,), (9,)], "conv_id int")
    assert [r.conv_id for r in ops.delete_sessions(messages, requests).collect()] == [1]
    assert {tuple(r) for r in ops.deletion_results(messages, requests).collect()} == {(2, True), (9, False)}


def test_failed_turns_get_the_error_answer(spark):
    from lexiframe.functions import fixed
    from lexiframe.operators.conversation import prompt_table

    questions = spark.createDataFrame([(1, "m", ""), (2, "m", ""), (3, "m", "")], "query_id bigint, message string, history string")
    contexts = spark.createDataFrame([(1, "c", 1), (2, "c", 1)], "query_id bigint, context string, passages bigint")
    failed = spark.createDataFrame([(2,)], "query_id bigint")
    got = {r.query_id: (r.prompt is None, r.answer) for r in prompt_table(questions, contexts, failed).collect()}
    assert got == {1: (False, None), 2: (True, fixed.PROCESSING_ERROR), 3: (True, fixed.NO_RELEVANT_CHUNKS)}
