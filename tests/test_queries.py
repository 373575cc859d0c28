import pytest

from plumbline.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, same):
    if name in ORACLE_SQL:
        same(QUERIES[name], ORACLE_SQL[name])
    else:
        QUERIES[name](spark, sf).collect()


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
