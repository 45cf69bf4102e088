"""Queries whose results SQL can express, against that SQL."""

import pytest
from compare import differences, oracle

from verdictflow.llm.oracle import ORACLE_SQL
from verdictflow.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), oracle(sf_dir), ORACLE_SQL[name]) == ""
