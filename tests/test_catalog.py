import pytest

import __spark_entry__ as entry
from check_oracles import compare, open_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    assert compare(entry.queries()[name](spark, FOLDER), tables, entry.oracle_sql()[name]) is None


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_flagship_learns_distributions(spark):
    rows = entry.entry(spark).groupBy("topic").sum("p").collect()
    assert len(rows) == 4 and all(abs(r["sum(p)"] - 1) < 1e-9 for r in rows)
