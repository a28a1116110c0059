"""Chat formatting and media columns: exact round trips and reference values."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiframe.llm import chat, media

MESSAGES = "conv_id long, turn long, role string, text string"


def formatted(df):
    return chat.format_messages(df.withColumn("parts", chat.text_parts(F.col("text"))))


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out[conv] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 1, "assistant", "yes </turn>\n<turn:user> <image:0> \\"),
    (1, 0, "user", "\\### Assistant: </turn> ok"),
    (1, 2, "assistant", None),
    (2, 0, None, "no role"),
    (2, 5, "a<b>\\c", "é\U0001f600" * 1000),
    (3, 0, "assistant", ""),
    (None, 0, "user", "lost"),
]


def test_conversations_round_trip(spark):
    df = spark.createDataFrame(ROWS, MESSAGES)
    got = chat.read_back(formatted(df.selectExpr("*", "1 as segment"))).collect()
    have = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got}
    assert have == expected(ROWS)
    chars = {r["conv_id"]: r["formatted_chars"] for r in got}
    assert chars[3] == len("<turn:assistant></turn>\n")
    assert chat.read_back(formatted(df.limit(0))).collect() == []


def test_repeated_turns_are_kept_and_order_does_not_matter(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    one = chat.read_back(formatted(spark.createDataFrame(rows, MESSAGES))).collect()
    two = chat.read_back(formatted(spark.createDataFrame(rows[::-1], MESSAGES).repartition(3))).collect()
    assert one == two and one[0]["n_turns"] == 3


@settings(max_examples=300, deadline=None)
@given(st.text("<>\\/turn:image0 \né", max_size=40), st.text("<>\\:a", max_size=8))
def test_any_text_survives_escaping(text, role):
    head = chat._ROLE_ESCAPE.sub(r"\\\g<0>", role)
    segment = f"<turn:{head}>{chat.escaped(text)}</turn>\n"
    assert chat.parse_segment(segment) == (role, text, [])


def test_parts_become_placeholders_in_order(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    parts = [
        ("text", "look <image:9> ", None, None, None, None, None),
        ("image", None, "s3/cat.png", 1024, 600, None, None),
        ("audio", None, "a.wav", None, None, 2.5, None),
        ("text", "and", None, None, None, None, None),
        ("document", None, "d.pdf", None, None, None, 3),
        ("hologram", None, "h", None, None, None, None),
    ]
    rows = [(1, 0, "user", parts), (1, 1, "user", None), (1, 2, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    got = {r["turn"]: r for r in chat.format_messages(df).collect()}
    first = got[0]
    assert first["segment"] == "<turn:user>look \\<image:9> <image:0><audio:1>and<document:2><document:3></turn>\n"
    assert [(a["ordinal"], a["type"], a["ref"]) for a in first["attachments"]] == [
        (0, "image", "s3/cat.png"), (1, "audio", "a.wav"), (2, "document", "d.pdf"), (3, "document", "h"),
    ]
    tokens = [chat.IMAGE_TOKENS + 4 * chat.TILE_TOKENS, 63, 3 * chat.PAGE_TOKENS, chat.PAGE_TOKENS]
    assert [a["tokens"] for a in first["attachments"]] == tokens
    assert first["tokens"] == sum(tokens) + 3 and first["placeholders"] == 4
    assert chat.parse_segment(first["segment"]) == (
        "user", "look <image:9> and", ["<image:0>", "<audio:1>", "<document:2>", "<document:3>"],
    )
    assert got[1]["segment"] == got[2]["segment"] == "<turn:user></turn>\n"


def test_token_counts_by_a_tokenizer_file(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hello there, world")], MESSAGES)
    df = df.withColumn("parts", chat.text_parts(F.col("text")))
    assert chat.format_messages(df, "/opt/tokenizers/byte_bpe_50k.json").first()["tokens"] == 4


def test_text_media_keep_every_byte(spark):
    texts = ["", None, "a", "é" * 31 + "xy", "é" * 32, "é" * 33, "long " * 40_000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "3 as media")
    for form in ("pgm", "bmp"):
        rows = sorted(media.media_features(media.text_media(docs, form)).collect())
        assert len(rows) == len(texts)
        for r, text in zip(rows, texts, strict=True):
            data = (text or "").encode()
            payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            assert r["n_bytes"] == len(data) and r["payload_bytes"] == len(payload)
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
            assert r["tail_crc32"] == zlib.crc32(payload[-64:])
            assert len(r["feature"]) == 16 and r["tiles"]
        assert rows[2][1:] == rows[7][1:] and rows[0][1:] == rows[1][1:]
    assert media.media_features(media.text_media(docs.limit(0))).collect() == []


def test_stored_form_is_what_is_hashed(spark):
    docs = spark.createDataFrame([(1, "x" * 100)], "doc_id long, text string")
    stored = bytes(media.text_media(docs).first()["media"])
    row = media.media_features(media.text_media(docs)).first()
    assert row["media_bytes"] == len(stored) and row["media_sha256"] == hashlib.sha256(stored).hexdigest()
    assert stored == b"P5\n64 2\n255\n" + b"x" * 100 + bytes(28)


RNG = np.random.default_rng(0)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (64, 64), (7, 33)])
def test_decoders_undo_encoders(shape):
    image = RNG.integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.pgm(image)) == image).all()
    assert (media.decode(media.bmp(image)) == image).all()
    assert (np.load(io.BytesIO(media.npy(image))) == image).all()


def test_other_forms():
    grey = np.array([[0, 7, 255], [3, 2, 1]])
    assert (media.decode(b"P2 # note\n3 2\n255\n0 7 255\n3 2 1\n") == grey).all()
    assert (media.decode(b"P1\n3 1\n1 0 1\n") == [[0, 1, 0]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[0, 1, 0]]).all()
    assert (media.decode(b"P6 2 1 255\n\x01\x02\x03\x04\x05\x06") == [[[1, 2, 3], [4, 5, 6]]]).all()
    assert (media.decode(b"P3 1 1 255\n9 8 7\n") == [[[9, 8, 7]]]).all()
    assert (media.decode(b"P5 2 1 65535\n\x01\x00\x00\x02") == [[256, 2]]).all()
    head = bytearray(media.bmp(np.zeros((1, 1), np.uint8))[:54])
    head[10:14], head[28:30] = (54).to_bytes(4, "little"), (24).to_bytes(2, "little")
    assert (media.decode(bytes(head) + b"\x03\x02\x01\x00") == [[[1, 2, 3]]]).all()
    for bad in (b"P5\n4 4\n255\nxx", b"GIF89a", b""):
        with pytest.raises(ValueError):
            media.decode(bad)


@pytest.mark.parametrize("shape", [(8, 9), (16, 18), (5, 7), (100, 64), (1, 1)])
def test_area_resize_equals_overlap_weights(shape, monkeypatch):
    image = RNG.integers(0, 256, shape, dtype=np.uint8)

    def weights(size, parts):
        edges = np.linspace(0, size, parts + 1)
        cells = np.arange(size)
        return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None)

    rows, cols = weights(shape[0], 8), weights(shape[1], 9)
    want = rows @ image @ cols.T / np.outer(rows.sum(1), cols.sum(1))
    assert np.allclose(media.resize(image, 8, 9), want)
    monkeypatch.setattr(media, "BAND", 7)
    assert np.allclose(media.resize(image, 8, 9), want)


def test_difference_hash_sees_direction():
    ramp = np.tile(np.arange(0, 90, dtype=np.uint8), (16, 1))
    assert media.difference_hash(ramp) == "f" * 16
    assert media.difference_hash(ramp[:, ::-1]) == "0" * 16
    assert len(media.tiles(ramp)) == 4 and np.load(io.BytesIO(media.tiles(ramp)[0])).shape == (16, 16)


def test_query_writes_the_tiles_of_every_document(spark):
    from lexiframe.llm.queries import op8_media

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op8_media(spark, folder).select("doc_id", "tiles").collect()
    assert len(rows) == len(texts) > 0
    for row in rows:
        text = (texts[row["doc_id"]] or "").encode()
        payload = text + bytes(-len(text) % media.WIDTH or (0 if text else media.WIDTH))
        image = np.frombuffer(payload, np.uint8).reshape(-1, media.WIDTH)
        want = media.tiles(image)
        assert [bytes(t) for t in row["tiles"]] == want and len(want) >= 1
        assert all(np.load(io.BytesIO(t)).shape == (media.TILE, media.TILE) for t in want)
