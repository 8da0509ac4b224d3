import pytest
from oracle import FOLDER, compare, connect

from tidelog.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, FOLDER)
    if name in SQL:
        compare(result, con, SQL[name])
    else:
        assert result.count() > 0
