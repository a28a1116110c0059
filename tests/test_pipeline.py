"""From page text to prompts."""

from lexiframe.functions import fixed
from lexiframe.operators.lines import select_pages, split_lines
from lexiframe.plans.answer import answer_prompts, retrieve
from lexiframe.plans.statutes import index_health, ingest, parse_statutes, publish_segments
from lexiframe.sources.index import read_index
from lexiframe.sources.jsonl import read_jsonl, write_jsonl

PAGES = [
    "SALINAN\nSampul",
    "SALINAN\nBAB I\nKETENTUAN UMUM\nPasal 1\nSetiap pengendara sepeda motor wajib memakai helm:\na. standar; dan",
    "SALINAN\n- 3 -\nb. nasional.\nPasal\n2\n(1)\nPejalan kaki berhak atas\ntrotoar.\n(2)\nParkir di trotoar dilarang.",
    "SALINAN\nDisahkan di Jakarta\nPresiden",
    "SALINAN\nPasal 1\nCukup jelas.\nPasal 2\nAyat (1)\nCukup jelas ayat satu.\nAyat (2)\nHuruf a\nContoh parkir.",
    "SALINAN\nTAMBAHAN LEMBARAN NEGARA REPUBLIK INDONESIA NOMOR 5025\nakhir",
]


def test_statute_to_prompt(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, i + 1, t) for i, t in enumerate(PAGES)], "doc_id int, page_no int, text string"
    )
    ranges = spark.createDataFrame(
        [(1, 2, 4, 5)], "doc_id int, body_start int, body_end int, elucidation_start int"
    )
    segments = parse_statutes(pages, ranges, header_lines=1)
    got = {
        (r.section, r.article_number, r.paragraph_number): r.text for r in segments.collect()
    }
    assert got == {
        ("body", 1, None): "Setiap pengendara sepeda motor wajib memakai helm:\na. standar; dan\nb. nasional.",
        ("body", 2, 1): "Pejalan kaki berhak atas trotoar.",
        ("body", 2, 2): "Parkir di trotoar dilarang.",
        ("elucidation", 1, None): "Cukup jelas.",
        ("elucidation", 2, 1): "Cukup jelas ayat satu.",
        ("elucidation", 2, 2): "Huruf a Contoh parkir.",
    }
    expected = spark.createDataFrame(
        [(1, s, 2) for s in ("body", "elucidation")],
        "doc_id int, section string, expected_articles bigint",
    )
    out = str(tmp_path / "segments")
    report = publish_segments(segments, expected, out)
    assert [r.is_valid for r in report.collect()] == [True, True]

    paths = {}
    for section in (fixed.BODY, fixed.ELUCIDATION):
        paths[section] = f"{out}/section={section}"
        assert read_jsonl(spark, paths[section]).count() == 3
    index = str(tmp_path / "index")
    ingest(spark, paths[fixed.BODY], paths[fixed.ELUCIDATION], index, 64)
    assert {r.chunk_type: r.chunks for r in index_health(spark, index).collect()} == {
        "body": 3,
        "elucidation": 3,
    }
    chunks = read_index(spark, index)
    questions = spark.createDataFrame(
        [(1, "Parkir di trotoar dilarang.", 1), (2, "wajib memakai helm", 0)],
        "query_id int, message string, top_k int",
    )
    best = {
        r.query_id: (r.article_number, r.paragraph_number)
        for r in retrieve(questions, chunks, rewriting=False).where("rank = 1").collect()
    }
    assert best == {1: (2, 2), 2: (1, None)}
    counts = retrieve(questions, chunks).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in counts} == {1: 1, 2: 5}
    prompt = answer_prompts(questions, chunks).where("query_id = 1").first().prompt
    assert prompt.startswith(fixed.PROMPT_CONTEXT_TITLE) and "Parkir di trotoar dilarang." in prompt


def test_page_in_both_ranges_is_read_twice(spark):
    pages = spark.createDataFrame([(1, 2, "a\n\n b ")], "doc_id int, page_no int, text string")
    ranges = spark.createDataFrame(
        [(1, 1, 2, 2)], "doc_id int, body_start int, body_end int, elucidation_start int"
    )
    rows = select_pages(split_lines(pages), ranges).collect()
    assert sorted((r.section, tuple(r.lines)) for r in rows) == [
        ("body", ("a", "b")),
        ("elucidation", ("a", "b")),
    ]


def test_rewritten_jsonl_replaces_the_old_one(spark, tmp_path):
    path = str(tmp_path / "x")
    for n in (5, 2):
        write_jsonl(spark.range(n).selectExpr("id as article_number", "'t' as text"), path)
    assert read_jsonl(spark, path).count() == 2
