import pytest

from tests.oracle import check
from voxcohort.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == {"split_assignment"}  # tests/test_splits.py
    assert len(QUERIES) >= 115


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    check(spark, SF, QUERIES[name], SQL[name])
