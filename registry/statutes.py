"""Line and segmentation queries.

Documents are rendered as statutes so that every segmentation rule occurs: nine lines make
an article, three of them a paragraph; every fourth article has no paragraphs, every seventh
article marker is split over two lines.  Chapter lines, page numbers, a stray paragraph
marker, a false split marker and trailing matter behind the end marker are added.
"""

from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.functions.text import non_blank_lines
from lexiframe.operators.lines import (
    classified_lines,
    default_rules,
    explode_lines,
    select_pages,
    skip_header,
    split_lines,
    trim_pages,
)
from lexiframe.operators.segment import segment
from registry.common import sql_lines, table

LINES_PER_PAGE = 10
RENDERED_PER_PAGE = 12
RULES = default_rules(header_lines=1)


def _paged(df, lines, per_page: int, decorate=lambda page, last: page):
    """One row per page of an array of lines, as (other columns, page_no, text)."""
    count = F.ceil(F.size(lines) / per_page).cast("int")
    others = [c for c in df.columns if c != lines]

    def page(p):
        part = F.slice(lines, (p - 1) * per_page + 1, F.lit(per_page))
        return F.struct(p.alias("page_no"), decorate(F.array_join(part, "\n"), p == count).alias("text"))

    # no filter on the array: it would be pushed down and split every text twice
    numbers = F.when(count > 0, F.sequence(F.lit(1), count))
    pages = F.explode(F.transform(numbers, page)).alias("p")
    return df.select(*others, pages).select(*others, "p.*")


def document_pages(spark, folder):
    """pages(doc_id, page_no, text) with ten lines per page."""
    docs = table(spark, folder, "documents").select(
        "doc_id", non_blank_lines(F.col("text")).alias("l")
    )
    return _paged(docs, "l", LINES_PER_PAGE)


def rendered_pages(spark, folder):
    """pages(doc_id, section, page_no, text) of every document in both section types."""
    docs = table(spark, folder, "documents").select(
        "doc_id", non_blank_lines(F.col("text")).alias("l")
    )
    docs = docs.withColumn(
        "section", F.explode(F.array(F.lit(fixed.BODY), F.lit(fixed.ELUCIDATION)))
    )
    body = F.col("section") == fixed.BODY

    def marker(number):
        text = F.concat(F.lit("("), number.cast("string"), F.lit(")"))
        return F.when(body, text).otherwise(F.concat(F.lit("Ayat "), text))

    def render(line, i):
        article, r = F.floor(i / 9), i % 9
        number = (article + 1).cast("string")
        first, numbered = r == 0, article % 4 != 3
        split = article % 7 == 6
        return F.concat_ws(
            "\n",
            F.when(first & (article % 5 == 0), "BAB I\nKETENTUAN"),
            F.when(first, F.concat(F.when(split, "Pasal\n").otherwise("Pasal "), number)),
            F.when(first, "Ketentuan pembuka"),
            F.when(numbered & (r % 3 == 0), marker(F.floor(r / 3) + 1)),
            F.when(numbered & (r == 5), marker(F.lit(99))),
            F.when(r == 7, F.concat(F.lit("- "), number, F.lit(" -"))),
            F.when(~numbered & (r == 4), "Pasal"),
            line,
        )

    rendered = docs.withColumn(
        "r", F.split(F.array_join(F.transform("l", render), "\n"), "\n")
    )
    end = F.when(body, fixed.BODY_END_MARKER).otherwise(fixed.ELUCIDATION_END_MARKER)

    def decorate(page, last):
        closing = F.when(last, F.concat(F.lit("\n"), end, F.lit("\nLampiran"))).otherwise("")
        return F.concat(F.lit("LEMBARAN NEGARA\n"), page, closing)

    return _paged(rendered.drop("l"), "r", RENDERED_PER_PAGE, decorate)


PAGES_SQL = f"""
pages_in AS (
    SELECT doc_id, p AS page_no, list_slice(l, (p - 1) * 10 + 1, p * 10) AS l
    FROM (SELECT doc_id, l, unnest(range(1, ((len(l) + 9) // 10) + 1)) AS p
          FROM (SELECT doc_id, {sql_lines("text")} AS l FROM documents) WHERE len(l) > 0))
"""

RENDER_SQL = f"""
src AS (
    SELECT doc_id, section, l FROM (SELECT doc_id, {sql_lines("text")} AS l FROM documents),
           (VALUES ('body'), ('elucidation')) s(section)
    WHERE len(l) > 0),
src_lines AS (
    SELECT doc_id, section, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM src),
pieces AS (
    SELECT doc_id, section, i, line, i // 9 AS a, i % 9 AS r,
           CASE section WHEN 'body' THEN '' ELSE 'Ayat ' END AS pre FROM src_lines),
rendered AS (
    SELECT doc_id, section, flatten(list(
        list_concat(list_concat(list_concat(list_concat(
        list_concat(list_concat(list_concat(list_concat(
        CASE WHEN r = 0 AND a % 5 = 0 THEN ['BAB I', 'KETENTUAN'] ELSE [] END,
        CASE WHEN r = 0 AND a % 7 = 6 THEN ['Pasal', (a + 1)::VARCHAR] ELSE [] END),
        CASE WHEN r = 0 AND a % 7 <> 6 THEN ['Pasal ' || (a + 1)] ELSE [] END),
        CASE WHEN r = 0 THEN ['Ketentuan pembuka'] ELSE [] END),
        CASE WHEN a % 4 <> 3 AND r % 3 = 0 THEN [pre || '(' || (r // 3 + 1) || ')'] ELSE [] END),
        CASE WHEN a % 4 <> 3 AND r = 5 THEN [pre || '(99)'] ELSE [] END),
        CASE WHEN r = 7 THEN ['- ' || (a + 1) || ' -'] ELSE [] END),
        CASE WHEN a % 4 = 3 AND r = 4 THEN ['Pasal'] ELSE [] END),
        [line]) ORDER BY i)) AS l
    FROM pieces GROUP BY ALL),
rendered_pages AS (
    SELECT doc_id, section, p AS page_no,
           list_concat(list_concat(['LEMBARAN NEGARA'], list_slice(l, (p - 1) * 12 + 1, p * 12)),
             CASE WHEN p * 12 >= len(l) THEN [CASE section WHEN 'body' THEN '{fixed.BODY_END_MARKER}'
                  ELSE '{fixed.ELUCIDATION_END_MARKER}' END, 'Lampiran'] ELSE [] END) AS l
    FROM (SELECT *, unnest(range(1, ((len(l) + 11) // 12) + 1)) AS p FROM rendered)),
rendered_lines AS (
    SELECT doc_id, section, page_no, unnest(l) AS text, generate_subscripts(l, 1) AS line_no
    FROM rendered_pages),
cuts AS (
    SELECT doc_id, section, page_no, min(line_no) AS cut FROM rendered_lines
    WHERE text = CASE section WHEN 'body' THEN '{fixed.BODY_END_MARKER}'
                 ELSE '{fixed.ELUCIDATION_END_MARKER}' END GROUP BY ALL),
kept_lines AS (
    SELECT doc_id, section, page_no, line_no - 1 AS line_no, text
    FROM rendered_lines LEFT JOIN cuts USING (doc_id, section, page_no)
    WHERE line_no > 1 AND (cut IS NULL OR line_no < cut))
"""


def lines_split(spark, folder):
    pages = table(spark, folder, "documents").select("doc_id", "text")
    return explode_lines(split_lines(pages)).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "text"
    )


def header_skip(spark, folder):
    pages = split_lines(document_pages(spark, folder))
    kept = pages.withColumn("lines", skip_header(F.col("lines"), 1))
    return explode_lines(kept).select(
        "doc_id",
        F.col("page_no").cast("bigint").alias("page_no"),
        F.col("line_no").cast("bigint").alias("line_no"),
        "text",
    )


def page_range(spark, folder):
    """Body is the first half of a document, elucidation starts on its last body page."""
    pages = document_pages(spark, folder)
    half = F.ceil(F.max("page_no") / 2)
    ranges = pages.groupBy("doc_id").agg(
        F.lit(1).alias("body_start"), half.alias("body_end"), half.alias("elucidation_start")
    )
    return select_pages(pages, ranges).select(
        "doc_id", "section", F.col("page_no").cast("bigint").alias("page_no"), "text"
    )


def end_marker_cut(spark, folder):
    pages = trim_pages(split_lines(rendered_pages(spark, folder)), RULES)
    return explode_lines(pages).select(
        "doc_id",
        "section",
        F.col("page_no").cast("bigint").alias("page_no"),
        F.col("line_no").cast("bigint").alias("line_no"),
        "text",
    )


def line_classify(spark, folder):
    pages = trim_pages(split_lines(rendered_pages(spark, folder)), RULES)
    return classified_lines(pages, RULES).select(
        "doc_id",
        "section",
        F.col("page_no").cast("bigint").alias("page_no"),
        F.col("line_no").cast("bigint").alias("line_no"),
        "line_class",
    )


def segment_statutes(spark, folder):
    segments = segment(rendered_pages(spark, folder), RULES, pages_per_block=8)
    return segments.select(
        "doc_id",
        "section",
        "occurrence",
        "article_number",
        F.coalesce("paragraph_number", F.lit(0)).alias("paragraph_number"),
        "text",
    )


def _list_test(column):
    return (
        f"CASE section WHEN 'body' THEN regexp_matches({column}, '{fixed.BODY_LIST_LINE}')"
        f" ELSE regexp_matches({column}, '{fixed.ELUCIDATION_LIST_LINE}') END"
    )


QUERIES = {
    "lines_split": lines_split,
    "header_skip": header_skip,
    "page_range": page_range,
    "end_marker_cut": end_marker_cut,
    "line_classify": line_classify,
    "segment_statutes": segment_statutes,
}

ORACLES = {
    "lines_split": f"""
        SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS text
        FROM (SELECT doc_id, {sql_lines("text")} AS l FROM documents)""",
    "header_skip": f"""
        WITH {PAGES_SQL}
        SELECT doc_id, page_no, line_no - 1 AS line_no, text
        FROM (SELECT doc_id, page_no, generate_subscripts(l, 1) AS line_no, unnest(l) AS text
              FROM pages_in) WHERE line_no > 1""",
    "page_range": f"""
        WITH {PAGES_SQL},
        half AS (SELECT doc_id, (max(page_no) + 1) // 2 AS h FROM pages_in GROUP BY doc_id)
        SELECT doc_id, section, page_no, array_to_string(l, chr(10)) AS text
        FROM pages_in JOIN half USING (doc_id), (VALUES ('body'), ('elucidation')) s(section)
        WHERE CASE section WHEN 'body' THEN page_no <= h ELSE page_no >= h END""",
    "end_marker_cut": f"WITH {RENDER_SQL} SELECT * FROM kept_lines",
    "line_classify": f"""
        WITH {RENDER_SQL}
        SELECT doc_id, section, page_no, line_no, CASE
            WHEN regexp_matches(text, '{fixed.PAGE_NUMBER_LINE}|{fixed.DOTS_LINE}|{fixed.SPACED_DOTS_LINE}')
                THEN 'skip'
            WHEN regexp_matches(text, '{fixed.CHAPTER_LINE}|{fixed.SECTION_LINE}|{fixed.SUBSECTION_LINE}')
                THEN 'section'
            WHEN regexp_matches(text, '{fixed.ARTICLE_LINE}') THEN 'article'
            WHEN text = 'Pasal' THEN 'bare'
            WHEN regexp_matches(text, CASE section WHEN 'body' THEN '{fixed.BODY_PARAGRAPH_LINE}'
                 ELSE '{fixed.ELUCIDATION_PARAGRAPH_LINE}' END) THEN 'paragraph'
            ELSE 'text' END AS line_class
        FROM kept_lines""",
    "segment_statutes": f"""
        WITH {RENDER_SQL},
        lead AS (
            SELECT doc_id, section, a, -1 AS r, 'Ketentuan pembuka' AS text FROM pieces WHERE r = 0),
        texts AS (
            SELECT doc_id, section, a, r,
                   CASE WHEN a % 4 = 3 AND r = 4 THEN 'Pasal ' || line ELSE line END AS text
            FROM pieces
            WHERE NOT regexp_matches(line, '{fixed.DOTS_LINE}|{fixed.SPACED_DOTS_LINE}')
            UNION ALL SELECT * FROM lead WHERE a % 4 = 3)
        SELECT doc_id, section, a + 1 AS occurrence, a + 1 AS article_number,
               CASE WHEN a % 4 = 3 THEN 0 ELSE r // 3 + 1 END AS paragraph_number,
               {"trim(substr(string_agg(CASE WHEN " + _list_test("text") + " THEN chr(10) ELSE ' ' END || text, '' ORDER BY r), 2))"} AS text
        FROM texts GROUP BY ALL""",
}
