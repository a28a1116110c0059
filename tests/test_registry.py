"""Every registered query against its DuckDB equivalent on the smallest scale factor."""

import pytest

import registry
from registry.compare import differences

ORACLES = registry.all_oracles()


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_query(spark, data_dir, name):
    df = registry.all_queries()[name](spark, data_dir)
    if name in ORACLES:
        assert differences(df, data_dir, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.all_queries())


def test_streaming_retrieval_equals_batch(spark, data_dir):
    from registry.streams import batch_retrieve, stream_retrieve

    streamed = sorted(map(tuple, stream_retrieve(spark, data_dir).collect()))
    assert streamed == sorted(map(tuple, batch_retrieve(spark, data_dir).collect()))
