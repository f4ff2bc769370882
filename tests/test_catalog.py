import pytest
from compare import SF, same

from palimpsest.plans import behaviour, catalog, extras, more

QUERIES, SQL = catalog.QUERIES | behaviour.QUERIES | extras.QUERIES | more.QUERIES, catalog.SQL | behaviour.SQL | extras.SQL | more.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df())


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(SQL) == {"vector_index_recall", "choice_chain"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _said():
    from palimpsest.plans import said

    return said


@pytest.mark.parametrize("name", sorted(_said().SQL))
def test_stated_messages_match_sql(spark, duck, name):
    got = _said().QUERIES[name](spark, SF).toPandas()
    same(got, duck.sql(_said().SQL[name]).df())
    assert len(got) > 0
