"""Queries do the whole job: all thresholds, whole volumes, masks that may be empty."""

import pytest

from voxcohort.operators.evaluation import FP_TARGETS, THRESHOLDS
from voxcohort.plans import QUERIES


@pytest.fixture(scope="module")
def faint(spark, tmp_path_factory):
    """Two cases. Case 0: a lesion found at 40 of 255 only, a false positive at 20. Case 1: nothing in either mask."""
    d = tmp_path_factory.mktemp("faint")
    marks = {0: ("error", 40.0), 1: ("error", 40.0), 505: ("view", 20.0)}
    rows = [(i, *marks.get(i, ("click", 1.0)), 0) for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, user_id long").coalesce(1).write.parquet(f"{d}/events.parquet")
    return str(d)


def test_the_sweep_has_all_thresholds(spark, faint):
    rows = [r for r in QUERIES["froc_curve"](spark, faint).collect() if (r.scope, r.report_bin) == ("overall", "all")]
    levels = [-(-255 * round(100 * p) // 100) for p in THRESHOLDS]
    assert sorted(r.threshold for r in rows) == levels and len(levels) == 21
    assert {r.threshold: (r.lesions, r.detected, r.fp_per_case) for r in rows} == {t: (1, int(t <= 40), 0.5 if t <= 20 else 0.0) for t in levels}


def test_targets_between_outer_thresholds_have_values(spark, faint):
    got = {r.target: r.sensitivity for r in QUERIES["froc_interpolate"](spark, faint).collect() if (r.scope, r.report_bin) == ("overall", "all")}
    assert set(got) == set(FP_TARGETS) and got[0.125] == got[0.25] == got[0.5] == 1.0 and got[1.0] is None


def test_masks_are_whole_and_may_be_empty(spark, tmp_path):
    """Case 0: two true voxels, one of them found, far from every slab. Case 1: both masks empty."""
    marks = {0 + 559: ("error", 70.0), 0 + 759: ("error", 50.0)}
    rows = [(i, *marks.get(i, ("click", 1.0)), 0) for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(run("mask_dice")) == [*((c, None, 1.0) for c in (-3, -2, -1)), (0, 0.666667, 0.666667), (1, None, 1.0)]
    assert sorted(run("macro_mean")) == [("D0", 2, 1, 0.666667), ("D1", 2, 0, None), ("D2", 1, 0, None)]
    assert sorted(r[:3] for r in run("wilson_interval")) == [*((c, 0, 0) for c in (-3, -2, -1)), (0, 1, 2), (1, 0, 0)]
    assert sorted(run("trim_profile")) == [(0, 0, 1), (0, 1, 0), (0, 2, 1)]
