import pytest

from tallyweave.plans.queries import ORACLE_SQL, QUERIES
from tests.helpers import SF, oracle, rows_of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, name):
    got = rows_of(QUERIES[name](spark, SF))
    if name in ORACLE_SQL:
        assert got == oracle(ORACLE_SQL[name])
    else:
        assert got[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
