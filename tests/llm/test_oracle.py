import pytest
from oracle import differences

from tesserae.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert not differences(spark, name, catalogue.queries()[name], catalogue.oracle_sql()[name])
