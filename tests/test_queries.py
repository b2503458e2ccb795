import pytest
from twins import connect, differences

from quarry.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, sf, con, name):
    run, sql = QUERIES[name]
    assert sql, "every query has SQL"
    assert differences(spark, sf, run, sql, con) == ""


def test_harness_sees_a_mismatch(spark, sf, con):
    run, sql = QUERIES["line_count"]
    assert differences(spark, sf, run, sql.replace("AS lines", "+ 1 AS lines"), con)
