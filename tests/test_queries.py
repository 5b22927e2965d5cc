import pytest

from oracle import agree
from quern.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        agree(df, SQL[name], sf)
    else:
        df.count()


def test_entry_point_has_every_query(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
