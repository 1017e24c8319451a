import pytest
from oracle import spark_rows, sql_rows
from orweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(queries.ORACLE_SQL[name], SF)
