"""Every query of the library's own operators against its SQL, and that it has one or a test of its own."""

from __future__ import annotations

import pytest
from conftest import same_as_sql

from recallspark import plans

#: Text functions that SQL lacks; tests/test_text.py holds them against a plain rule.
WITHOUT_SQL = {"f7_summaries", "f8_chunks"}


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    if name in plans.oracle_sql():
        same_as_sql(df, duck, plans.oracle_sql()[name])
    else:
        assert name in WITHOUT_SQL
        df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
