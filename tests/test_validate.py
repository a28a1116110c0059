"""Integrity checks and gated publication."""

import glob

from lexiframe.operators import validate as ops
from lexiframe.operators.evaluate import (
    acceptance_judgements,
    categorize,
    judged_hits,
    recall_precision,
    related_articles,
)
from lexiframe.plans.statutes import publish_segments

SCHEMA = "doc_id int, section string, article_number int, paragraph_number int, text string"
EXPECTED = "doc_id int, section string, expected_articles bigint"


def segments(spark, rows):
    return spark.createDataFrame([(d, "body", a, p, "t") for d, a, p in rows], SCHEMA)


ROWS = [
    (1, 1, 1), (1, 1, 2), (1, 2, None),  # valid
    (2, 1, 1), (2, 1, 4), (2, 3, 1), (2, 9, None), (2, 9, 0),  # gaps, above N, null = 0
    (3, 1, None), (3, 2, None),  # no paragraph at all
]


def test_findings_and_report(spark):
    seg = segments(spark, ROWS)
    expected = spark.createDataFrame([(d, "body", 2 if d != 2 else 3) for d in (1, 2, 3, 4)], EXPECTED)
    missing = sorted((r.doc_id, r.article_number) for r in ops.missing_articles(seg, expected).collect())
    assert missing == [(2, 2), (4, 1), (4, 2)]
    gaps = sorted(tuple(r)[::2] + (r[3],) for r in ops.missing_paragraphs(seg).collect())
    assert gaps == [(2, 1, 2), (2, 1, 3)]
    twice = [(r.doc_id, r.article_number, r.paragraph_number, r.occurrences) for r in ops.duplicate_keys(seg).collect()]
    assert twice == [(2, 9, 0, 2)]
    report = {r.doc_id: r for r in ops.validation_report(seg, expected).collect()}
    assert report[1].is_valid and report[1].status == "checked"
    two = report[2]
    assert (two.total_articles, two.missing_articles, two.missing_paragraphs, two.duplicate_keys) == (3, 1, 2, 1)
    assert not two.is_valid
    assert report[3].status == "no_paragraphs" and not report[3].is_valid
    assert report[4].total_articles == 0 and not report[4].is_valid


def test_only_valid_documents_are_published(spark, tmp_path):
    seg = segments(spark, ROWS)
    expected = spark.createDataFrame([(d, "body", 2 if d != 2 else 3) for d in (1, 2, 3)], EXPECTED)
    report = publish_segments(seg, expected, str(tmp_path / "out"))
    assert report.count() == 3
    assert [r.doc_id for r in spark.read.json(str(tmp_path / "out")).select("doc_id").distinct().collect()] == [1]
    line = open(sorted(glob.glob(str(tmp_path / "out/section=body/*.json")))[0]).readline()
    assert '"doc_id":1' in line and '"paragraph_number":' in line


def test_long_ranges_are_generated_in_steps(spark):
    expected = spark.createDataFrame([(1, "body", 10_000)], EXPECTED)
    seg = segments(spark, [(1, n, 1) for n in range(1, 10_000, 2)])
    missing = ops.missing_articles(seg, expected)
    assert missing.count() == 5_000 and missing.distinct().count() == 5_000


def test_categories_and_related_articles(spark):
    rows = spark.createDataFrame([(1,), (46,), (47,), (326,), (327,)], "a int")
    assert [r.category for r in categorize(rows, "a").orderBy("a").collect()] == [
        "Road Infrastructure", "Road Infrastructure", "Vehicles", "Transitional", None,
    ]
    related = related_articles(spark)
    sim = sorted(r.article_number for r in related.where("term = 'SIM'").collect())
    assert sim == [*range(77, 89), 281, 288]


def test_judgements(spark):
    questions, wanted = acceptance_judgements(spark)
    assert questions.count() == 7
    hits = spark.createDataFrame(
        [(5, 1, 110, None), (5, 2, 106, 4), (5, 3, 106, 1), (5, 4, 113, None)],
        "query_id bigint, rank int, article_number bigint, paragraph_number bigint",
    )
    judged = judged_hits(hits, wanted)
    assert [r.relevant for r in judged.orderBy("rank").collect()] == [1, 1, 0, 0]
    n = spark.createDataFrame([(5, 4), (6, 2)], "query_id bigint, n_relevant int")
    got = {r.query_id: (r.recall, r.precision) for r in recall_precision(judged, n).collect()}
    assert got == {5: (0.5, 0.4), 6: (0.0, 0.0)}


def test_judgement_ranges_are_compared_not_spread(spark):
    hits = spark.createDataFrame(
        [(1, 1, 7, 2), (1, 2, None, None), (2, 1, 8, None), (2, 1, 8, None), (3, 1, 5, None), (4, 1, 5, None)],
        "query_id bigint, rank int, article_number bigint, paragraph_number bigint",
    )
    wanted = spark.createDataFrame(
        [(1, 0, 9 * 10**15, 2), (1, 0, 9 * 10**15, 2), (2, 8, 8, 0), (2, 1, 9, None), (3, 6, 4, None), (4, None, 9, None)],
        "query_id bigint, lo bigint, hi bigint, paragraph bigint",
    )
    judged = judged_hits(hits, wanted)
    got = sorted((r.query_id, r["rank"], r.relevant) for r in judged.collect())
    assert got == [(1, 1, 1), (1, 2, 0), (2, 1, 1), (2, 1, 1), (3, 1, 0), (4, 1, 0)]


def test_only_checked_and_valid_documents_are_published(spark):
    from lexiframe.operators.validate import only_valid

    segments = spark.createDataFrame(
        [(1, "body", 1), (2, "body", 7), (3, "body", 1), (4, "body", 1), (4, "notes", 1), (None, "body", 1)],
        "doc_id bigint, section string, article_number bigint",
    )
    report = spark.createDataFrame(
        [(1, "body", True), (3, "body", None), (4, "body", True)], "doc_id bigint, section string, is_valid boolean"
    )
    assert [r.doc_id for r in only_valid(segments, report).collect()] == [1]
