"""Queries of the training-data operators against DuckDB on the smallest tables."""

import pytest

from lexiframe.llm.queries import ORACLES, QUERIES
from registry.compare import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data_dir, name):
    assert differences(QUERIES[name](spark, data_dir), data_dir, ORACLES[name]) == ""


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_is_registered():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and set(QUERIES) <= set(entry.queries())
