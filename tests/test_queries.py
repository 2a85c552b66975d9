"""Every registered query of the library's own operators against its SQL."""

import pytest
from compare import both
from conftest import SMALL

from postlake.catalog import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    got, wanted = both(queries()[name], oracle_sql()[name], spark, SMALL)
    assert got == wanted


def test_stream_equals_batch(spark):
    stream = queries()["stream_sync"](spark, SMALL)
    batch = queries()["sync_statuses"](spark, SMALL).drop("change")
    assert sorted(map(repr, stream.collect())) == sorted(map(repr, batch.select(*stream.columns).collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(oracle_sql()) <= set(__spark_entry__.queries())
