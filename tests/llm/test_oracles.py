"""Queries of this subpackage that have SQL, against DuckDB."""

import os

import pytest
from compare import duck, spark_rows

from veldt.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(q.queries()[name](spark, SF)) == duck(SF, q.oracle_sql()[name])
