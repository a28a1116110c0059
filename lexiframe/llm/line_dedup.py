"""Line dedup by site-relative frequency (operator 1).

Pages are grouped by host.  A line is boilerplate on a host when it is on at least ``min_pages`` of
the host's pages and on more than ``max_ratio`` of them; such lines go from every page of that
host and stay on others.

Only DataFrame functions are used.  Pages are cut into lines once and written; only line hashes are
exploded and aggregated, with partial sums before the shuffle.  A host can have at most
``mean lines per page / max_ratio`` boilerplate lines, so the list that meets its pages is bounded
however large the host is, and page texts are not shuffled while that table is small.

Defined results: null or empty HTML has no lines; a null address or one without a host belongs to
host ''; a repeated page counts as a page of its own; a line repeated within a page counts once; a
table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import checked_broadcast
from lexiframe.session import checkpointed

MAX_RATIO = 0.3
MIN_PAGES = 3

# Patterns shared with the SQL equivalent; both engines read them alike.
HIDDEN = r"(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<!--.*?-->"
BREAKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header"
    r"|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[ \t\r\n/][^>]*)?>"
)
TAGS = r"<[^>]*>"
LINE_END = r"[\r\n]+"
BLANK = " \t"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of an address; '' when there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """Visible text of a page as trimmed, non-empty lines in order."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    lines = F.transform(F.split(text, LINE_END), lambda line: F.btrim(line, F.lit(BLANK)))
    return F.filter(lines, lambda line: line != "")


def line_key(line: Column) -> Column:
    """96 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate_lines(
    pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``(host, drop)``: keys of the boilerplate lines of each host of ``pages(host, lines)``."""
    totals = checkpointed(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    counts = (
        pages.select("host", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("key"))
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
    )
    return (
        counts.join(checked_broadcast(totals), "host")
        .where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("key").alias("drop"))
    )


def dedup_lines(
    pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` for every page."""
    cut = checkpointed(
        pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines")),
        "lines",
    )
    drop = checkpointed(boilerplate_lines(cut, max_ratio, min_pages), "boilerplate")
    known = F.coalesce(F.col("drop"), F.array().cast("array<struct<a:bigint,b:int>>"))
    kept = F.filter("lines", lambda line: ~F.array_contains(F.col("known"), line_key(line)))
    return (
        cut.join(checked_broadcast(drop, 1 << 14), "host", "left")
        .withColumn("known", known)
        .withColumn("kept", F.when(F.size("known") == 0, F.col("lines")).otherwise(kept))
        .select(
            "page_id",
            "host",
            F.size("lines").cast("bigint").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
            F.array_join("kept", "\n").alias("text"),
        )
    )
