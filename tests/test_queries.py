import pytest

from testkit.catalog import ORACLES, QUERIES
from testkit.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    assert name in ORACLES
    assert compare(df, ORACLES[name], duck) == ""
