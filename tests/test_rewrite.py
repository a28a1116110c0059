"""Dictionary expansion, model answers and sub-queries."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.operators import rewrite as ops
from lexiframe.operators import substrings
from lexiframe.operators.dictionary import PatternMatcher
from lexiframe.plans.answer import rewrite

MESSAGES = [
    "Apakah MENEROBOS lampu merah melanggar aturan?",
    "di simpang jalan",
    "helm dan sabuk pengaman untuk motor",
    "tidak ada",
]


@pytest.fixture
def questions(spark):
    return spark.createDataFrame(list(enumerate(MESSAGES)), "query_id bigint, message string")


def by_id(df, *columns):
    return {r.query_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_expansions_in_dictionary_order(spark, questions):
    want = {}
    for i, m in enumerate(MESSAGES):
        fired = [(t, x) for t, x in fixed.TERM_EXPANSIONS if t in m.lower()]
        want[i] = ([t for t, _ in fired], [e for _, x in fired for e in x])
    assert want[1][0] == ["sim"]  # no word boundaries
    assert by_id(ops.expand_terms(questions), "matched_terms", "static_terms") == want
    table = ops.term_table(spark)
    assert by_id(ops.expand_terms(questions, table), "matched_terms", "static_terms") == want
    assert by_id(ops.expand_terms(questions, table, max_bytes=200), "matched_terms", "static_terms") == want
    special = by_id(ops.special_pattern(questions, ops.pattern_table(spark), max_bytes=200), "special_query")
    assert special == by_id(ops.special_pattern(questions), "special_query")
    assert special[2] == (dict(fixed.SPECIAL_REWRITES)["helm"],)  # first match wins


def test_bounded_rows_refuses_large_tables(spark):
    big = spark.range(1000).select(F.col("id").cast("string").alias("p"))
    assert substrings.bounded_rows(big, ["p"]) is None
    assert len(substrings.bounded_rows(big.limit(3), ["p"])) == 3


@pytest.mark.parametrize(
    "answer,query,phrases",
    [
        ('```json\n{"legal_search_query": "q", "key_legal_phrases": ["a", ""]}\n```', "q", ["a", ""]),
        ('```\n{"legal_search_query": "q"}\n```', "q", []),
        ('  {"key_legal_phrases": ["a"]}  ', "", ["a"]),
        ('{"legal_search_query": "q"', None, None),
        ("[1, 2]", None, None),
        ('"text"', None, None),
        ("null", None, None),
        ("", None, None),
        ("{'legal_search_query': 'q'}", None, None),
        ('{"legal_search_query": "q"} and more', None, None),
        (None, None, None),
    ],
)
def test_model_answers(spark, answer, query, phrases):
    for message, special in [("helm baru", fixed.SPECIAL_REWRITES[3][1]), ("sim baru", None)]:
        terms = [e for t, x in fixed.TERM_EXPANSIONS if t in message for e in x]
        row = spark.createDataFrame(
            [(1, message, answer)], "query_id bigint, message string, llm_response string"
        )
        got = rewrite(row).first()
        if query is None:
            assert got.legal_search_query == (special or " ".join([message, *terms]))
            assert got.key_phrases == terms
        else:
            assert got.legal_search_query == (f"{special} {query}" if special else query)
            assert got.key_phrases == phrases


def test_subquery_order_and_limits(spark):
    rows = [
        (1, "m", "q", ["a", "", None, "b"], ["s1", "s2"]),
        (2, "m", "q", ["a", "b", "c", "d"], ["s1"]),
        (3, "m", "", [], [f"s{i}" for i in range(7)]),
    ]
    schema = (
        "query_id bigint, message string, legal_search_query string,"
        " key_phrases array<string>, static_terms array<string>"
    )
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in ops.subqueries(df).orderBy("query_id", "list_prio", "sub_query").collect():
        got.setdefault(r.query_id, []).append((r.list_type, r.sub_query, r.k, r.search_text))
    head = [("legal_query", 0, 10, "q"), ("original_query", 0, 10, "m")]
    extra = lambda *t: [("additional", i, 5, x) for i, x in enumerate(t)]
    assert got[1] == head + extra("a", "b", "s1 s2")
    assert got[2] == head + extra("a", "b", "c")  # static terms only below three phrases
    assert got[3] == head[1:] + extra("s0 s1 s2 s3 s4")  # empty legal query: no legal search
    plain = ops.subqueries(df, rewriting=False).where("query_id = 1").collect()
    assert [(r.list_type, r.search_text) for r in plain] == [
        ("legal_query", "m"),
        ("original_query", "m"),
    ]


def test_analytics(spark, questions):
    expanded = ops.expand_terms(questions)
    counts = {r.term: r.questions for r in ops.query_analytics(expanded).collect()}
    assert counts[None] == 1 and counts["helm"] == 1 and counts["lampu merah"] == 1
    assert [r.query_id for r in ops.unmatched_questions(expanded).collect()] == [3]
    assert [r["rank"] for r in ops.top_topics(expanded, 2).collect()] == [1, 2]


@pytest.mark.parametrize("answer", ['{"legal_search_query": "q"} }', '{"legal_search_query": "q"} note ]}', '{"legal_search_query": "q"}{"b": 1}', '{"legal_search_query": "q"} note {x}', '{"legal_search_query": "q"} {}'])
def test_content_after_the_answer_is_no_json(spark, answer):
    row = spark.createDataFrame([(1, "m", answer)], "query_id bigint, message string, llm_response string")
    assert rewrite(row).first().legal_search_query == "m"


def test_brackets_in_strings_do_not_count(spark):
    answer = '{"legal_search_query": "a } b { \\" ] c", "key_legal_phrases": ["x[", "y"]}'
    row = spark.createDataFrame([(1, "m", answer)], "query_id bigint, message string, llm_response string")
    assert rewrite(row).first().legal_search_query == 'a } b { " ] c'


def test_dictionaries_of_any_size_agree(spark):
    entries = [(0, " ", ["space"]), (0, "bar", ["b"]), (0, "", ["all"]), (1, "foo", ["f"]), (1, "az", ["z"])]
    terms = spark.createDataFrame(entries, "prio int, term string, expansions array<string>")
    patterns = spark.createDataFrame([(p, t, x[0]) for p, t, x in entries], "prio int, pattern string, rewrite string")
    questions = spark.createDataFrame([(1, "foo bar baz"), (2, "nothing"), (3, None)], "query_id bigint, message string")

    def answers(**limits):
        static = {r.query_id: r.static_terms for r in ops.expand_terms(questions, terms, **limits).collect()}
        special = {r.query_id: r.special_query for r in ops.special_pattern(questions, patterns, **limits).collect()}
        return static, special

    small = answers()
    assert small[0][1] == ["all", "space", "b", "z", "f"] and small[1] == {1: "all", 2: "all", 3: None}
    assert answers(max_bytes=64) == answers(max_bytes=1) == small


@pytest.mark.parametrize("max_bytes", [1 << 20, 500, 1])
def test_rows_not_ids_get_their_entries(spark, max_bytes):
    """Repeated and null ids, repeated, blank, nested and null entries, empty and null texts."""
    entries = [(1, "foo", ["a"]), (1, "foo", ["a"]), (0, None, ["n"]), (None, "oo", ["o"]), (2, "", None), (1, "fo\nx", ["y"]),
               (1, "foo", ["A"]), (3, "ö ö", ["u", "v"]), (3, " ", [])]
    terms = spark.createDataFrame(entries, "prio int, term string, expansions array<string>")
    texts = [(1, "foo bar"), (1, "other"), (None, "foo"), (None, "other"), (2, None), (2, ""), (3, "FO\nX ö ö"), (3, "ofoofoo")]
    questions = spark.createDataFrame(texts, "query_id bigint, message string").repartition(3)
    got = ops.expand_terms(questions, terms, max_bytes=max_bytes).collect()
    order = sorted(entries, key=lambda e: (e[0] is not None, e[0] or 0, e[1] or "", e[2] or []))
    want = []
    for q, m in texts:
        fired = [] if m is None else [(t, x) for _, t, x in order if t is not None and t in m.lower()]
        nothing = any(x is None for _, x in fired)  # an entry without expansions
        want.append((q, m, [t for t, _ in fired], None if nothing else [e for _, x in fired for e in x]))
    assert sorted(map(str, ((r.query_id, r.message, r.matched_terms, r.static_terms) for r in got))) == sorted(map(str, want))


def test_empty_dictionary(spark, questions):
    none = ops.term_table(spark, [])
    assert {tuple(r.static_terms) for r in ops.expand_terms(questions, none).collect()} == {()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abö ", max_size=4), max_size=12), st.text("abö ", max_size=30))
def test_matcher_equals_contains(patterns, text):
    assert PatternMatcher(patterns).numbers(text) == [i for i, p in enumerate(patterns) if p in text]
