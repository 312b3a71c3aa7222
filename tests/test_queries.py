import pytest

from oracle import differ
from tidemark.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert differ(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF) is None
