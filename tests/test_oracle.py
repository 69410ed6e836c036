"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, df = compare.spark_result(spark, QUERIES[name], SF)
    if name in ORACLE:
        assert compare.difference(got, compare.duck_result(duck, ORACLE[name])) is None
        assert compare.type_difference(df, duck, ORACLE[name]) is None
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).columns == ["template", "n", "first", "last", "example"]


def test_sql_only_for_known_queries():
    assert set(ORACLE) <= set(QUERIES)
