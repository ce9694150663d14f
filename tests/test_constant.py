"""Queries on profiles against their SQL where a profile is constant."""

import math

import pytest

from voxcohort.plans import QUERIES, SQL

from .oracle import check


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    """Case 0: 'view' rises by slice, 'click' has one voxel in each. Case 1: 'view' has one in each, 'error' rises."""
    d = tmp_path_factory.mktemp("flat")
    kinds = (("view", "click"), ("error", "view"))
    rows = [(1000 * c + 100 * z + i, rise if i < z + 1 else even, 200.0 if i < z + 2 else 1.0, 0) for c, (rise, even) in enumerate(kinds) for z in range(10) for i in range(100)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, user_id long").coalesce(1).write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["orientation_decision", "profile_correlation", "evidence_vote"])
def test_constant_profiles(spark, flat, name):
    check(spark, flat, QUERIES[name], SQL[name])


def test_constant_profiles_are_met(spark, flat):
    got = {(r.case_id, r.phase): r for r in QUERIES["orientation_decision"](spark, flat).collect()}
    assert math.isnan(got[0, "click"].direct) and math.isnan(got[0, "click"].reversed) and not got[0, "click"].relative_flip
    assert math.isnan(got[1, "error"].direct) and not got[1, "error"].relative_flip
