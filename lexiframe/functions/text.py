"""Text expressions with Unicode-aware whitespace, all evaluated in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.strip() sees it; Java's own classes are narrower.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"[\s\x1c-\x1f]"  # needs (?U)
_LINE_BREAK = r"[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"  # \r\n only adds a blank line


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(col, F.lit(WHITESPACE))


def non_blank_lines(col: Column) -> Column:
    """Stripped, non-blank lines of a text, in order."""
    lines = F.transform(F.split(col, _LINE_BREAK), strip)
    return F.filter(lines, lambda line: line != "")


def matches(col: Column, *patterns: str) -> Column:
    """Whether one of the patterns matches at the start of the text.

    Unicode whitespace classes; the leading anchor spares the search at later positions.
    """
    return col.rlike("(?U)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def words(col: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.filter(F.split(col, rf"(?U){_SPACE}+"), lambda w: w != "")


def keyword_tokens(col: Column) -> Column:
    """Lower-cased alphanumeric tokens used for keyword ranking."""
    return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda w: w != "")


def first_number(col: Column) -> Column:
    """First run of digits as BIGINT, null when absent or out of range."""
    return F.regexp_extract(col, r"([0-9]+)", 1).try_cast("bigint")
