import pytest

from eventide.plans import catalog

QUERIES, SQL = catalog.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, same, name):
    same(QUERIES[name](spark, sf_dir), SQL[name])


def test_entry_has_them(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
