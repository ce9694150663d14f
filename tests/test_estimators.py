"""Estimators against values computed by hand."""

import math

import numpy as np
from pyspark.sql import functions as F

from voxcohort.operators import estimators as S

FUSE = "p string, phase string, own double, pairs long, specific boolean, slices long, size_z long"


def fused(spark, rows):
    return {r.phase: (round(r.spacing, 6), r.basis, r.confidence, r.spread if r.spread is None else round(r.spread, 6)) for r in S.fuse(spark.createDataFrame(rows, FUSE), "p").collect()}


def test_fixed_values():
    assert (S.PRIOR_EXTENT, S.PRIOR_PART, S.MIN_SLICES, S.RELATIVE_MARGIN, S.STRONG_EVIDENCE, S.INCONSISTENT, S.SMALL_PART) == (170.0, 0.96, 8, 0.05, 0.30, 0.15, 0.6)
    assert len(S.PAIRS) == 10 and all(S.LEVELS.index(b) == S.LEVELS.index(a) + 1 for a, b, _ in S.PAIRS) and math.isclose(sum(x[2] for x in S.PAIRS), 300.0)


def test_fusion_without_any_vertebrae(spark):
    # No pairs at all: the prior extent over the liver's slices, or over 96 % of the volume's where there is no liver.
    got = fused(spark, [("a", "NC", None, 0, False, 85, 100), ("a", "AP", None, 0, False, 0, 100), ("a", "DP", None, 0, False, 0, 0)])
    assert got == {"NC": (2.0, S.PRIOR, "low", None), "AP": (round(170 / 96, 6), S.COUNT, "low", None), "DP": (170.0, S.COUNT, "low", None)}


def test_fusion_of_phases_that_agree(spark):
    # Extents 160 (weight 6), 168 (weight 4): the lower median is 160; spread 8 / 160 = 0.05.
    got = fused(spark, [("a", "NC", 2.0, 3, True, 80, 90), ("a", "AP", 2.1, 2, True, 80, 90), ("a", "DP", None, 0, False, 40, 90)])
    assert got == {"NC": (2.0, S.SHARED, "high", 0.05), "AP": (2.0, S.SHARED, "high", 0.05), "DP": (4.0, S.SHARED, "high", 0.05)}


def test_own_vertebrae_win_where_the_liver_is_cut(spark):
    # AP's liver spans a part only: 2.0 * 50 = 100 against 160. It keeps its own spacing and is not in the spread.
    got = fused(spark, [("a", "NC", 2.0, 4, True, 80, 90), ("a", "AP", 2.0, 2, True, 50, 90), ("a", "DP", 2.0, 1, True, 50, 90), ("a", "PVP", 1.5, 1, True, 0, 90)])
    assert got["AP"] == (2.0, S.OWN_WINS, "medium", 0.375)
    assert got["DP"] == (3.2, S.SHARED, "low", 0.375)  # one pair is not sure: it counts in the spread, 60 / 160
    assert got["PVP"] == (1.5, S.OWN_ONLY, "low", 0.375)


def test_vertebra_spacing(spark):
    # Going up: L2 at 0, L1 at 10, T12 at 20, then a gap to T10 at 35.
    rows = [("s", "L2", 0.0, 3.0, False), ("s", "L1", 10.0, 3.0, False), ("s", "T12", 20.0, 3.0, False), ("s", "T10", 35.0, 2.0, False), ("s", "T9", 40.0, 2.0, True)]
    rows += [("g", "T12", 0.0, 2.0, False), ("g", "T10", 10.0, 2.0, False), ("g", "T8", 50.0, 2.0, False)]  # 20 mm is plausible, 80 mm is not
    rows += [("n", "T10", 0.0, 2.0, False), ("n", "T12", 10.0, 2.0, False)] + [("e", "L2", 0.0, 1.0, True), ("e", "L1", 30.0, 1.0, False)]
    df = spark.createDataFrame(rows, "v string, level string, z double, guess double, touches_edge boolean")
    got = {r.v: (round(r.spacing, 6), r.pairs, r.specific) for r in S.vertebra_spacing(df, ["v"]).collect()}
    assert got == {"s": (round((33.5 + 31.5) / 20, 6), 2, True), "g": (3.0, 1, False)}
    assert round(S.vertebra_spacing(df, ["v"], 1.1).where("v = 'g'").first().spacing, 6) == 3.3


def test_liver_slices(spark):
    df = spark.createDataFrame([(100, 0), (100, 150), (100, 170), (5, 40), (5, 0), (5, None), (None, 30)], "a int, b int")
    assert [r.n for r in df.select(S.liver_slices(F.coalesce("a", F.lit(0)), F.col("b")).alias("n")).collect()] == [100, 100, 170, 40, 0, 0, 30]


def test_orientation(spark):
    rise = [10.0, 40.0, 70.0, 80.0, 85.0, 88.0, 90.0, 90.0, 88.0, 86.0]  # tapers at the low end
    margin = (70 - 10) / 90 - (90 - 86) / 90
    rows = [("a", "PVP", rise), ("a", "AP", rise[::-1]), ("a", "NC", [1.0] * 5), ("b", "AP", [1.0] * 7), ("c", "AP", rise[::-1]), ("c", "DP", [5.0] * 10), ("z", "PVP", [5.0] * 10)]
    got = {(r.p, r.phase): r for r in S.orientation(spark.createDataFrame(rows, "p string, phase string, profile array<double>"), "p", "PVP", ("NC", "AP", "PVP", "DP")).collect()}
    a, b = got["a", "PVP"], got["a", "AP"]
    assert a.flip and not a.relative_flip and a.direct is None and math.isclose(a.margin, margin) and math.isclose(a.evidence, 2 * margin) and a.source == S.STRONG
    assert not b.flip and b.relative_flip and math.isclose(b.reversed, 1) and math.isclose(b.margin, -margin)
    x = np.interp(np.linspace(0, 1, 100), np.linspace(0, 1, 10), rise)
    assert math.isclose(b.direct, np.corrcoef(x[::-1], x)[0, 1])
    assert got["a", "NC"].flip and got["a", "NC"].margin == 0  # too short to vote: as the reference
    assert got["b", "AP"].flip and got["b", "AP"].source == S.DEFAULT and got["b", "AP"].evidence == 0
    assert not got["c", "AP"].flip and got["c", "DP"].direct == got["c", "DP"].reversed == 0  # constant: no relative flip
    assert got["z", "PVP"].flip and got["z", "PVP"].source == S.WEAK  # evidence of exactly 0
