import pytest

from lociweave.llm import queries as Q

from ..oracle import compare, runs


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, Q.queries()[name], Q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.ORACLE_SQL)))
def test_query_runs(spark, name):
    runs(spark, Q.queries()[name])
