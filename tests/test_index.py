"""Chunk table sinks, JSON lines, embedding hook."""

import pytest

from lexiframe.operators.chunks import embed_with, hash_embed, to_chunks, token_windows
from lexiframe.plans.statutes import ingest
from lexiframe.sources import index as ix
from lexiframe.sources.jsonl import read_jsonl, write_jsonl

SEGMENTS = "article_number bigint, paragraph_number bigint, chunk_type string, text string"


def chunks(spark, rows):
    return hash_embed(to_chunks(spark.createDataFrame(rows, SEGMENTS)))


ROWS = [(1, 1, "body", "satu dua"), (1, 2, "body", "tiga"), (2, None, "body", ""), (2, 0, "elucidation", "x")]


def test_ids_and_null_paragraphs(spark):
    got = {r.chunk_id: r.paragraph_number for r in chunks(spark, ROWS).collect()}
    assert got == {"art1_p1_body": 1, "art1_p2_body": 2, "art2_body": None, "art2_elucidation": 0}


def test_rebuild_append_scan_truncate_bootstrap(spark, tmp_path):
    path = str(tmp_path / "index")
    ix.bootstrap_index(chunks(spark, ROWS[:1]), path)
    ix.bootstrap_index(chunks(spark, ROWS), path)  # exists: nothing happens
    assert ix.count_index(spark, path).first().chunks == 1
    ix.rebuild_index(chunks(spark, ROWS[:2]), path, 64)
    assert ix.count_index(spark, path).first().chunks == 2
    ix.append_chunks(chunks(spark, ROWS), path)
    ix.append_chunks(chunks(spark, ROWS), path)
    assert ix.count_index(spark, path).first().chunks == 4
    scan = ix.scan_index(spark, path)
    assert "embedding" not in scan.columns and scan.count() == 4
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1]
    ix.truncate_index(spark, path)
    assert ix.count_index(spark, path).first().chunks == 0
    assert "embedding" in ix.read_index(spark, path).columns


def test_colliding_ids_and_wrong_width_keep_the_old_index(spark, tmp_path):
    path = str(tmp_path / "index")
    ix.rebuild_index(chunks(spark, ROWS), path, 64)
    with pytest.raises(ValueError, match="not unique"):
        ix.rebuild_index(chunks(spark, [ROWS[0], ROWS[0]]), path)
    with pytest.raises(ValueError, match="wide"):
        ix.rebuild_index(chunks(spark, ROWS), path, 32)
    assert ix.count_index(spark, path).first().chunks == 4
    mixed = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    with pytest.raises(Exception, match="not 1 wide: b"):
        ix.rebuild_index(mixed, str(tmp_path / "other"), 1)
    assert ix.count_index(spark, path).first().chunks == 4


def test_embed_hook_batches_and_aborts(spark):
    df = spark.range(120).selectExpr("id", "cast(id as string) as text").coalesce(1)
    got = embed_with(df, lambda texts: [[float(len(texts)), float(t)] for t in texts])
    rows = got.orderBy("id").collect()
    assert [r.embedding[0] for r in rows] == [50.0] * 100 + [20.0] * 20
    assert [int(r.embedding[1]) for r in rows] == list(range(120))

    def broken(texts):
        raise RuntimeError("no quota")

    with pytest.raises(Exception, match="no quota"):
        embed_with(df, broken).collect()


def test_hash_embed_is_unit_length_or_zero(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, text string")
    vectors = {r.id: r.embedding for r in hash_embed(df).collect()}
    assert abs(sum(x * x for x in vectors[1]) - 1) < 1e-6
    assert not any(vectors[2]) and not any(vectors[3])


def test_jsonl_blank_and_malformed_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "é\nb")], "article_number bigint, paragraph_number bigint, text string")
    path = str(tmp_path / "out")
    write_jsonl(df, path)
    write_jsonl(df, path)  # overwrite
    assert [tuple(r) for r in read_jsonl(spark, path).collect()] == [(1, None, "é\nb")]
    good = tmp_path / "good.jsonl"
    good.write_text('{"article_number": 1, "text": "a"}\n\n   \n{"article_number": 2, "text": "b"}\n')
    assert read_jsonl(spark, str(good)).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"article_number": 1, "text": "a"}\n{"article_number": \n')
    with pytest.raises(Exception):
        read_jsonl(spark, str(bad)).collect()


def test_ingest_reads_both_files(spark, tmp_path):
    for name, n in (("body", 3), ("elucidation", 2)):
        lines = [f'{{"article_number": {i}, "paragraph_number": null, "text": "t{i}"}}' for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    path = str(tmp_path / "index")
    ingest(spark, str(tmp_path / "body.jsonl"), str(tmp_path / "elucidation.jsonl"), path, 64)
    kinds = [r.chunk_type for r in ix.read_index(spark, path).collect()]
    assert sorted(kinds) == ["body"] * 3 + ["elucidation"] * 2


@pytest.mark.parametrize("n,windows", [(0, 0), (1, 1), (300, 1), (301, 2), (570, 2), (571, 3)])
def test_token_windows(spark, n, windows):
    df = spark.createDataFrame([(1, " ".join(map(str, range(n))))], "id int, text string")
    rows = token_windows(df).orderBy("chunk_index").collect()
    assert len(rows) == windows
    for r in rows:
        tokens = r.text.split()
        assert len(tokens) == r.token_count <= 300 and tokens[0] == str(270 * r.chunk_index)
    assert not rows or rows[-1].text.split()[-1] == str(n - 1)


def test_a_late_bad_vector_keeps_the_old_index(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "chunk_id string, embedding array<float>"
    ix.rebuild_index(spark.createDataFrame([("old", [1.0])], schema), path, 1)
    mixed = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], schema)
    with pytest.raises(Exception, match="not 1 wide: b"):
        ix.rebuild_index(mixed, path, 1)
    assert [r.chunk_id for r in ix.read_index(spark, path).collect()] == ["old"]


def test_append_raises_on_clashes_and_widths(spark, tmp_path):
    path = str(tmp_path / "index")
    ix.rebuild_index(chunks(spark, ROWS[:2]), path, 64)
    other = [(1, 1, "body", "another text")]
    for clash in (other, [(9, 1, "body", "one"), (9, 1, "body", "two")]):
        with pytest.raises(ValueError, match="chunk ids"):
            ix.append_chunks(chunks(spark, clash), path)
    narrow = chunks(spark, [(8, 1, "body", "x")]).selectExpr("* except (embedding)", "array(1f) as embedding")
    with pytest.raises(ValueError, match="wide"):
        ix.append_chunks(narrow, path)
    assert ix.count_index(spark, path).first().chunks == 2


def test_ids_name_their_document(spark):
    rows = [(7, 1, 1, "body", "a"), (8, 1, 1, "body", "b"), (None, 1, 1, "body", "c")]
    df = spark.createDataFrame(rows, f"doc_id bigint, {SEGMENTS}")
    got = {r.chunk_id: r.doc_id for r in to_chunks(df).collect()}
    assert got == {"doc7_art1_p1_body": 7, "doc8_art1_p1_body": 8, "art1_p1_body": None}


def test_an_append_meets_the_index_once(spark, tmp_path, monkeypatch):
    """The join that finds clashes gives the new rows as well; it shuffles all texts."""
    path, plans, write = str(tmp_path / "index"), [], ix.VersionedTable.write_data

    def seen(self, df, *how):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, df, *how)

    monkeypatch.setattr(ix.VersionedTable, "write_data", seen)
    rows = [(None if i == 3 else f"c{i}", f"text {i}", [float(i)]) for i in range(9)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<float>")
    ix.bootstrap_index(chunks.where("text < 'text 5'"), path)
    ix.append_chunks(chunks, path)
    ix.append_chunks(chunks, path)
    assert len(plans) == 3 and not any("Join" in plan for plan in plans)
    assert sorted(map(str, ix.read_index(spark, path).collect())) == sorted(map(str, chunks.collect()))
    with pytest.raises(ValueError, match="c7"):
        ix.append_chunks(spark.createDataFrame([("c7", "other", [1.0]), ("c99", "new", [1.0])], chunks.schema), path)
    assert ix.read_index(spark, path).count() == 9
