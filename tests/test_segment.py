"""Segmentation against a small sequential oracle on random documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.operators.lines import default_rules
from lexiframe.operators import segment as module
from lexiframe.operators.segment import segment

VOCABULARY = {
    "body": ["(1)", "(2)", "(3)", "(99)", "a. huruf", "1. angka", "b.", fixed.BODY_END_MARKER],
    "elucidation": [
        "Ayat (1)", "Ayat (2)", "Ayat (3)", "(1)", "Huruf a", "Huruf b teks",
        fixed.ELUCIDATION_END_MARKER,
    ],
}
COMMON = [
    "Pasal 1", "Pasal 2", "Pasal 5", "Pasal", "Pasal", "1", "2", "3", "4", "6", "- 7 -",
    "bersambung...", "lihat . . .", "BAB II", "Bagian Kesatu", "Paragraf 3", "teks biasa",
    "kata lain", "Pasal 3 ayat", "Pasal 2", "teks  dua",
]


def render(rng, section):
    words = COMMON + VOCABULARY[section]
    return [
        "\n".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        for _ in range(rng.randint(1, 9))
    ]


def expected(pages, rule):
    """Sequential reading of the segmentation rules."""
    segments, buffer = [], []
    article = paragraph = None
    inside = bare = False

    def close():
        text = "".join(buffer).strip()
        if text:
            segments.append((article, paragraph, text))
        buffer.clear()

    for page in pages:
        lines = [x.strip() for x in page.splitlines() if x.strip()][rule.header_lines :]
        if rule.end_marker in lines:
            lines = lines[: lines.index(rule.end_marker)]
        for line in lines:
            if any(re.match(p, line) for p in rule.skipped):
                continue
            if any(re.match(p, line) for p in rule.section_markers):
                inside = False
                continue
            opens = re.match(rule.article, line)
            if not opens and re.match(rule.bare_article, line):
                bare = True
                continue
            was_bare, bare = (bare, bare) if opens else (bare, False)
            split = was_bare and not opens
            if opens or (split and line.isdigit() and int(line) == (article or 0) + 1):
                close()
                article, paragraph, inside = int(line.split()[-1]), None, True
                continue
            if split:
                line = "Pasal " + line
            if re.match(rule.paragraph, line):
                number = int(re.search(r"\d+", line)[0])
                if number == (paragraph or 0) + 1:
                    if paragraph:
                        close()
                    buffer.clear()
                    paragraph = number
                continue
            if inside:
                buffer.append(("\n" if re.match(rule.ordered_list, line) else " ") + line)
    close()
    return segments


@pytest.mark.parametrize("header,per_block,open_blocks", [(0, 1, 256), (0, 1, 0), (1, 2, 1), (0, 64, 256)])
def test_random_documents(spark, header, per_block, open_blocks, monkeypatch):
    """Blocks of any size, folded in a row or followed by pointers."""
    monkeypatch.setattr(module, "OPEN_BLOCKS", open_blocks)
    rng = random.Random(7 + header + per_block)
    rules = default_rules(header)
    rows, want = [], {}
    for doc in range(250):
        for section in rules:
            pages = render(rng, section)
            rows += [(doc, section, i + 1, page) for i, page in enumerate(pages)]
            got = expected(pages, rules[section])
            if got:
                want[(doc, section)] = got
    pages = spark.createDataFrame(rows, "doc_id bigint, section string, page_no int, text string")
    have = {}
    for r in segment(pages, rules, per_block).orderBy("occurrence", "paragraph_number").collect():
        have.setdefault((r.doc_id, r.section), []).append(
            (r.article_number, r.paragraph_number, r.text)
        )
    assert len(want) > 300
    wrong = [k for k in want.keys() | have.keys() if want.get(k) != have.get(k)]
    assert not wrong, (wrong[0], want.get(wrong[0]), have.get(wrong[0]))


def test_one_document_over_hundreds_of_blocks(spark, monkeypatch):
    """Split markers that count up over 600 blocks, with false ones in between, and one article over the rest."""
    monkeypatch.setattr(module, "OPEN_BLOCKS", 16)
    rules, pages, want = default_rules(), [], []
    for i in range(1, 601):
        false = "Pasal\n7\n" if i % 3 == 0 else ""
        pages.append(f"{false}Pasal\n{i}\nisi {i}")
    for i in range(1, 301):
        pages.append(f"({i})\nayat {i}\n(7)\nlagi")
    want = expected(pages, rules["body"])
    assert len(want) == 899 and {a for a, _, _ in want} == set(range(1, 601))
    rows = [(5, "body", i + 1, page) for i, page in enumerate(pages)]
    df = spark.createDataFrame(rows, "doc_id bigint, section string, page_no int, text string")
    got = segment(df, rules, 1).orderBy("occurrence", "paragraph_number").collect()
    assert [(r.article_number, r.paragraph_number, r.text) for r in got] == want


def test_unicode_space_and_breaks(spark):
    text = "Pasal 1  satu \x1c(1)\u0085　dua　\r\nPasal 2\x0btiga"
    pages = spark.createDataFrame(
        [(1, "body", 1, text)], "doc_id bigint, section string, page_no int, text string"
    )
    got = segment(pages, default_rules()).orderBy("occurrence").collect()
    assert [(r.article_number, r.paragraph_number, r.text) for r in got] == [
        (1, 1, "dua"),
        (2, None, "tiga"),
    ]


def test_pages_are_split_and_classified_once(spark):
    """Markers and text come from lines that are written once."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [(doc, "body", i + 1, f"Pasal {i + 1}\n(1)\nisi {doc} {i}") for doc in range(3) for i in range(4)]
    pages = spark.createDataFrame(rows, "doc_id bigint, section string, page_no int, text string")
    pages = pages.withColumn("text", counted.asNondeterministic()("text"))
    got = segment(pages, default_rules(), 2).collect()
    want = [(doc, i + 1, 1, f"isi {doc} {i}") for doc in range(3) for i in range(4)]
    assert sorted((r.doc_id, r.article_number, r.paragraph_number, r.text) for r in got) == want
    assert read.value == len(rows)
