import pytest

from lacuna.llm.queries import ORACLES, QUERIES
from oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name])
