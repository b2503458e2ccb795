import pytest
from twins import differences

from quarry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, sf, name):
    assert differences(spark, sf, queries.queries()[name], queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_one_row_per_input_row(spark, sf, name):
    table = "pages" if name.startswith(("op2_", "op3_")) else "documents"
    assert queries.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
