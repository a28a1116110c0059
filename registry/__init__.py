"""Registered queries over the given tables, each with its DuckDB equivalent."""

import sys

from pyspark import cloudpickle

from registry import (
    conversation,
    evaluation,
    indexing,
    keyword,
    retrieval,
    rewriting,
    statutes,
    streams,
    validation,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import it

_PARTS = (
    statutes,
    validation,
    indexing,
    retrieval,
    rewriting,
    keyword,
    conversation,
    evaluation,
    streams,
)


def all_queries():
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def all_oracles():
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}


def index_searches():
    """Search alone on an index built before: name -> (build, search(spark, folder, index))."""
    return {name: pair for part in _PARTS for name, pair in getattr(part, "SEARCHES", {}).items()}
