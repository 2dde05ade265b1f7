"""Every registered query of the event log against its SQL, on the smallest tables."""

import os

import pytest
from compare import duck, spark_rows

from veldt.plans import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(q.queries()[name](spark, SF)) == duck(SF, q.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
