"""Page text to classified lines.  Everything here is a projection of one page row."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.functions.text import first_number, matches, non_blank_lines

PAGE = ["doc_id", "section", "page_no"]


@dataclass(frozen=True)
class Rules:
    """Patterns that drive segmentation of one section type."""

    end_marker: str
    paragraph: str
    ordered_list: str
    header_lines: int = 0
    article: str = fixed.ARTICLE_LINE
    bare_article: str = fixed.BARE_ARTICLE_LINE
    section_markers: tuple = (fixed.CHAPTER_LINE, fixed.SECTION_LINE, fixed.SUBSECTION_LINE)
    skipped: tuple = (fixed.PAGE_NUMBER_LINE, fixed.DOTS_LINE, fixed.SPACED_DOTS_LINE)


def default_rules(header_lines: int = 0) -> dict[str, Rules]:
    """Rule sets for statute bodies and their elucidations."""
    return {
        fixed.BODY: Rules(
            fixed.BODY_END_MARKER,
            fixed.BODY_PARAGRAPH_LINE,
            fixed.BODY_LIST_LINE,
            header_lines,
        ),
        fixed.ELUCIDATION: Rules(
            fixed.ELUCIDATION_END_MARKER,
            fixed.ELUCIDATION_PARAGRAPH_LINE,
            fixed.ELUCIDATION_LIST_LINE,
            header_lines,
        ),
    }


def per_section(rules: dict[str, Rules], build) -> Column:
    """CASE over the section column with one branch per rule set."""
    branches = None
    for section, rule in rules.items():
        test, value = F.col("section") == section, build(rule)
        branches = F.when(test, value) if branches is None else branches.when(test, value)
    return branches


def split_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """Replace page text by its array of stripped, non-blank lines."""
    return pages.withColumn("lines", non_blank_lines(F.col(text))).drop(text)


def select_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Tag pages as body (start..end, inclusive) and elucidation (start onwards).

    ranges(doc_id, body_start, body_end, elucidation_start); a page inside both ranges is
    returned once per section.
    """
    page = F.col("page_no")
    sections = F.array_compact(
        F.array(
            F.when(page.between(F.col("body_start"), F.col("body_end")), F.lit(fixed.BODY)),
            F.when(page >= F.col("elucidation_start"), F.lit(fixed.ELUCIDATION)),
        )
    )
    return (
        pages.join(ranges, "doc_id")
        .withColumn("section", F.explode(sections))
        .drop("body_start", "body_end", "elucidation_start")
    )


def skip_header(lines: Column, header_lines: int) -> Column:
    return F.slice(lines, header_lines + 1, F.greatest(F.size(lines), F.lit(1)))


def cut_at(lines: Column, marker: str) -> Column:
    """Lines before the first line equal to the marker."""
    position = F.array_position(lines, F.lit(marker))
    before = F.slice(lines, F.lit(1), F.greatest(position - 1, F.lit(0)).cast("int"))
    return F.when(position > 0, before).otherwise(lines)


def trim_pages(pages: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """Drop header lines and everything from the end marker on, per page."""
    kept = per_section(
        rules, lambda r: cut_at(skip_header(F.col("lines"), r.header_lines), r.end_marker)
    )
    return pages.withColumn("lines", kept)


def explode_lines(pages: DataFrame) -> DataFrame:
    """One row per line; line_no counts from 1 inside the page."""
    others = [c for c in pages.columns if c != "lines"]
    return pages.select(*others, F.posexplode("lines").alias("_i", "text")).select(
        *others, (F.col("_i") + 1).alias("line_no"), "text"
    )


def line_class(text: Column, r: Rules) -> Column:
    """skip, section, article, bare, paragraph or text; the first that matches.

    Plain text is most lines, so one alternation of all patterns settles it first.
    """
    every = (*r.skipped, *r.section_markers, r.article, r.bare_article, r.paragraph)
    return (
        F.when(~matches(text, *every), "text")
        .when(matches(text, *r.skipped), "skip")
        .when(matches(text, *r.section_markers), "section")
        .when(matches(text, r.article), "article")
        .when(matches(text, r.bare_article), "bare")
        .when(matches(text, r.paragraph), "paragraph")
        .otherwise("text")
    )


def classified_lines(pages: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """One row per line with ``line_class`` and ``number``.

    Classes are computed inside the page's array, so later filters on them cannot be
    pushed below the explode and repeat the pattern tests.  ``number`` is the article or
    paragraph number, or the value of an all-digit line.
    """
    def line(text, i):
        return F.struct(
            (i + 1).alias("line_no"),
            text.alias("text"),
            per_section(rules, lambda r: line_class(text, r)).alias("line_class"),
        )

    others = [c for c in pages.columns if c != "lines"]
    lines = pages.select(*others, F.explode(F.transform("lines", line)).alias("l"))
    text = F.col("l.text")
    numbered = F.col("l.line_class").isin("article", "paragraph") | text.rlike("^[0-9]+$")
    return lines.select(
        *others,
        "l.line_no",
        "l.text",
        "l.line_class",
        F.when(numbered, first_number(text)).alias("number"),
    )
