"""Every query against its SQL twin on the smallest tables."""

import pytest
from conftest import DATA, same_rows

from siteloom.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        mine, theirs = same_rows(df, duck.sql(ORACLES[name]))
        assert mine == theirs
    else:
        assert df.count() > 0


def test_entry_without_optional_parts():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
