import pytest

from marginalia import catalogue

from compare import database, expected, rows_of


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert rows_of(catalogue.queries()[name](spark, sf_dir)) == expected(con, catalogue.oracles()[name])
