import pytest
from compare import spark_rows, sql_rows
from orweave import suite

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(suite.queries()))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(suite.queries()[name](spark, SF)) == sql_rows(suite.oracle_sql()[name], SF)
