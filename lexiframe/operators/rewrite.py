"""Question rewriting: dictionary expansion, special patterns, model answers, sub-queries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.functions.text import strip
from lexiframe.operators.dictionary import fired_entries
from lexiframe.operators.substrings import contained

_LLM_SCHEMA = "legal_search_query string, key_legal_phrases array<string>, _bad string"


def term_table(spark, entries=fixed.TERM_EXPANSIONS) -> DataFrame:
    """Ordered term dictionary as a table (prio, term, expansions)."""
    rows = [(i, t, list(x)) for i, (t, x) in enumerate(entries)]
    return spark.createDataFrame(rows, "prio int, term string, expansions array<string>")


def pattern_table(spark, entries=fixed.SPECIAL_REWRITES) -> DataFrame:
    """Ordered pattern dictionary as a table (prio, pattern, rewrite)."""
    rows = [(i, p, r) for i, (p, r) in enumerate(entries)]
    return spark.createDataFrame(rows, "prio int, pattern string, rewrite string")


def expand_terms(
    questions: DataFrame, terms: DataFrame | None = None, text: str = "message", **limits
) -> DataFrame:
    """Add ``static_terms``: expansions of every term inside the lower-cased question.

    Dictionary order (``prio``, then term), duplicates kept, no word boundaries.  ``matched_terms`` lists the
    dictionary terms that fired.  The result belongs to the row, whatever its id.
    """
    lowered = questions.withColumn("_lowered", F.lower(F.col(text)))
    if terms is None:  # a few fixed entries need no pass of their own
        entries = [
            (t, F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, x)).alias("expansions")))
            for t, x in fixed.TERM_EXPANSIONS
        ]
        fired = lowered.withColumn("_fired", contained(F.col("_lowered"), entries))
    else:
        fired = fired_entries(lowered, "_lowered", terms.select("prio", "term", "expansions"), "term", "_fired", **limits)
    return (
        fired.withColumn("matched_terms", F.transform("_fired", lambda e: e["term"]))
        .withColumn("static_terms", F.flatten(F.transform("_fired", lambda e: e["expansions"])))
        .drop("_fired", "_lowered")
    )


def special_pattern(
    questions: DataFrame, patterns: DataFrame | None = None, text: str = "message", **limits
) -> DataFrame:
    """Add ``special_query``: rewrite of the first pattern, in order, inside the question."""
    lowered = questions.withColumn("_lowered", F.lower(F.col(text)))
    if patterns is None:
        chosen = F.lit(None).cast("string")
        for pattern, rewrite in reversed(fixed.SPECIAL_REWRITES):
            chosen = F.when(F.contains(F.col("_lowered"), F.lit(pattern)), F.lit(rewrite)).otherwise(chosen)
        return lowered.withColumn("special_query", chosen).drop("_lowered")
    entries = patterns.select("prio", "pattern", "rewrite")
    fired = fired_entries(lowered, "_lowered", entries, "pattern", "_fired", **limits)
    first = F.get("_fired", F.lit(0))["rewrite"]
    return fired.withColumn("special_query", first).drop("_fired", "_lowered")


def _without_fence(answer: Column) -> Column:
    body = strip(answer)
    opened = F.regexp_replace(body, r"\A```(?:json)?\n?", "")
    unfenced = F.regexp_replace(opened, r"\n?```\z", "")
    return F.when(F.startswith(body, F.lit("```")), unfenced).otherwise(body)


def _one_value(json: Column) -> Column:
    """Do the brackets outside of strings close exactly once and nothing after, so that one value is all there is?"""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")

    def step(state, bracket):
        depth = state["depth"] + F.when(bracket.isin("{", "["), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (state["closed"] + (depth == 0).cast("int")).alias("closed"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))
    marks = F.filter(F.split(brackets, ""), lambda c: c != "")
    return F.aggregate(marks, start, step, lambda state: (state["closed"] == 1) & (state["depth"] == 0))


def parse_llm_rewrite(rewrites: DataFrame, text: str = "message") -> DataFrame:
    """Turn a model's JSON answer into search query and key phrases, with fallbacks.

    Input needs ``llm_response``, ``static_terms`` and ``special_query``.  A missing key
    takes its default; an answer that is no JSON object falls back to the special query,
    or the question followed by its static terms, with the static terms as phrases.
    """
    cleaned = _without_fence(F.col("llm_response"))
    options = {
        "allowSingleQuotes": "false",
        "columnNameOfCorruptRecord": "_bad",
        "mode": "PERMISSIVE",
    }
    parsed = F.from_json(cleaned, _LLM_SCHEMA, options)
    closed = F.coalesce(F.endswith(strip(cleaned), F.lit("}")), F.lit(False))
    whole = F.coalesce(_one_value(cleaned), F.lit(False))
    usable = F.col("_p").isNotNull() & F.col("_p._bad").isNull() & closed & whole
    answered = F.coalesce(F.col("_p.legal_search_query"), F.lit(""))
    fallback = F.coalesce(
        F.col("special_query"),
        F.array_join(F.concat(F.array(F.col(text)), F.col("static_terms")), " "),
    )
    with_special = F.when(
        F.col("special_query").isNotNull(), F.concat_ws(" ", "special_query", answered)
    ).otherwise(answered)
    no_phrases = F.array().cast("array<string>")
    return (
        rewrites.withColumn("_p", parsed)
        .withColumn("parsed", usable)
        .withColumn(
            "legal_search_query", F.when(F.col("parsed"), with_special).otherwise(fallback)
        )
        .withColumn(
            "key_phrases",
            F.when(
                F.col("parsed"), F.coalesce(F.col("_p.key_legal_phrases"), no_phrases)
            ).otherwise(F.col("static_terms")),
        )
        .drop("_p")
    )


def additional_queries(rewrites: DataFrame) -> DataFrame:
    """Add ``additional``: non-empty phrases, then the first static terms joined."""
    phrases = F.filter("key_phrases", lambda p: p.isNotNull() & (p != ""))
    joined = F.array_join(F.slice("static_terms", 1, fixed.STATIC_TERMS_JOINED), " ")
    terms = F.when(F.size("static_terms") > 0, F.array(joined)).otherwise(
        F.array().cast("array<string>")
    )
    return rewrites.withColumn(
        "additional", F.slice(F.concat(phrases, terms), 1, fixed.MAX_ADDITIONAL_BUILT)
    )


def subqueries(rewrites: DataFrame, text: str = "message", rewriting: bool = True) -> DataFrame:
    """One row per search to run: legal query, original question, up to three additional.

    Without rewriting the question itself is the legal query and nothing is added.  An
    empty legal query yields no legal search.
    """
    def entry(list_type, prio, number, k, value):
        return F.struct(
            F.lit(list_type).alias("list_type"),
            F.lit(prio).alias("list_prio"),
            number.alias("sub_query"),
            F.lit(k).alias("k"),
            value.alias("search_text"),
        )

    question = F.col(text)
    legal = F.col("legal_search_query") if rewriting else question
    base = F.array(
        entry(fixed.LEGAL, 0, F.lit(0), fixed.VECTOR_TOP_K, legal),
        entry(fixed.ORIGINAL, 1, F.lit(0), fixed.VECTOR_TOP_K, question),
    )
    if rewriting:
        rewrites = additional_queries(rewrites)
        extra = F.transform(
            F.slice("additional", 1, fixed.MAX_ADDITIONAL_USED),
            lambda q, i: entry(fixed.ADDITIONAL, 2, i, fixed.ADDITIONAL_TOP_K, q),
        )
        base = F.concat(base, extra)
    kept = F.filter(
        base, lambda s: (s["list_prio"] != 0) | (F.coalesce(s["search_text"], F.lit("")) != "")
    )
    return rewrites.select("query_id", F.explode(kept).alias("s")).select("query_id", "s.*")


def query_analytics(expanded: DataFrame) -> DataFrame:
    """Topic counts: questions per matched term, and questions no term matched."""
    topics = F.when(F.size("matched_terms") > 0, F.col("matched_terms")).otherwise(
        F.array(F.lit(None).cast("string"))
    )
    return (
        expanded.select(F.explode(topics).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("questions"))
    )


def unmatched_questions(expanded: DataFrame) -> DataFrame:
    """Questions that match no dictionary term."""
    return expanded.where(F.size("matched_terms") == 0)


def top_topics(expanded: DataFrame, k: int) -> DataFrame:
    """The k most frequent topics."""
    order = Window.orderBy(F.desc("questions"), "term")
    counts = query_analytics(expanded).where(F.col("term").isNotNull())
    return counts.orderBy(F.desc("questions"), "term").limit(k).withColumn(
        "rank", F.row_number().over(order)
    )
