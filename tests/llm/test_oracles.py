import pytest

from brindle.llm.sql import ORACLE_SQL
from tests.llm.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, name, "/root/testdata/sf0.001")
