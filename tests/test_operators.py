import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxcohort.functions import scalars as fn
from voxcohort.operators import components, estimators, evaluation, records, registration, taxonomy, volumes
from voxcohort.operators.components import drop_small, label, label_components, label_components_joined


def brute(points):
    left, out = set(points), {}
    while left:
        seed = min(left)
        todo, members = [seed], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.discard(p)
                members.add(p)
                todo += [q for q in left if all(abs(a - b) <= 1 for a, b in zip(p, q, strict=True))]
        out |= {m: min(members) for m in members}
    return out


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(*[st.integers(-3, 5)] * 3), max_size=60))
def test_label_equals_brute_force(points):
    rows = sorted(points)
    names = label(np.array(rows, dtype=np.int64).reshape(-1, 3))
    assert {p: rows[k] for p, k in zip(rows, names, strict=True)} == brute(points)


def cube(case, at, n, start=0):
    return [(case, at + z, at + y, at + x) for z in range(n) for y in range(n) for x in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(c, z, y, x, (z * 100 + y) * 100 + x) for c, z, y, x in rows], "case_id long, z int, y int, x int, voxel_id long")


def test_joined_components_equal_grouped(spark):
    rng = random.Random(5)
    rows = [(c, *p) for c in (1, 2) for p in {tuple(rng.randrange(7) for _ in range(3)) for _ in range(70)}]
    v = table(spark, rows).withColumn("voxel_id", F.col("voxel_id") + F.col("case_id") * 1_000_000)
    a, b = ({(r.case_id, r.voxel_id, r.component) for r in f(v).collect()} for f in (label_components, label_components_joined))
    assert a == b and len(a) == len(rows)


def test_missed_lesion_exact_hit_and_false_positive(spark):
    truth = label_components(table(spark, cube(1, 5, 3) + cube(1, 15, 10)))
    found = label_components(table(spark, cube(1, 15, 10) + cube(1, 0, 2)))
    cases = spark.createDataFrame([(1, "A")], "case_id long, dataset string")
    rows = evaluation.lesions(truth, found, ("case_id",), ("case_id",), 1.0).withColumn("dataset", F.lit("A"))
    fps = evaluation.false_positives(truth, found, ("case_id",), ("case_id",), 1.0).withColumn("dataset", F.lit("A"))
    by = {r.voxels: r for r in rows.collect()}
    assert not by[27].detected and by[27].lesion_dice == 0
    assert by[1000].detected and by[1000].lesion_dice == 1 and by[1000].covered_fraction == 1
    assert fps.count() == 1
    m = {(r.scope, r.size_bin): r for r in evaluation.detection_metrics(cases, rows, fps).collect()}
    assert len(m) == 8 and m["overall", "0_5mm"].sensitivity == 0 and m["overall", "10_15mm"].sensitivity == 1
    assert m["A", "5_10mm"].sensitivity is None and m["A", "5_10mm"].lesions == 0
    assert drop_small(found, 9).count() == 1000


def test_covered_at_exactly_a_tenth_and_double_touch(spark):
    truth = label_components(table(spark, [(1, 0, 0, x) for x in range(20)] + [(1, 5, 0, x) for x in range(20)]))
    found = label_components(table(spark, [(1, z, 0, 0) for z in range(6)] + [(1, 0, 0, 1)]))
    rows = {r.lesion: r for r in evaluation.lesions(truth, found, ("case_id",), ("case_id",), 1.0).collect()}
    assert rows[0].covered == 2 and rows[0].detected
    assert rows[50000].covered == 1 and not rows[50000].detected
    assert evaluation.false_positives(truth, found, ("case_id",), ("case_id",), 1.0).count() == 0
    assert math.isclose(rows[0].lesion_dice, 2 * 2 / (20 + 7))


def test_contingency_equals_joins(spark):
    rng = random.Random(11)
    rows = [(c, z, y, x, (z * 10 + y) * 10 + x + 1000 * c, rng.random() < 0.12, rng.randrange(256) if rng.random() < 0.2 else 0) for c in (1, 2) for z in range(8) for y in range(8) for x in range(8)]
    v = spark.createDataFrame(rows, "case_id long, z int, y int, x int, voxel_id long, gt boolean, p255 int")
    levels = (60, 200)
    table = components.contingency(v, "p255", levels)
    truth = label_components(v.where("gt"))
    found = label_components(v.where("p255 > 0").withColumn("threshold", F.explode(F.array(*map(F.lit, levels)))).where("p255 >= threshold"), ("case_id", "threshold"))
    keys = ("case_id", "threshold")
    names = ("case_id", "threshold", "lesion", "voxels", "size_bin", "covered", "detected", "lesion_dice")
    a = evaluation.lesions_of(table, 60.0).select(*names).collect()
    b = evaluation.lesions(truth, found, ("case_id",), keys, 60.0, spark.createDataFrame([(t,) for t in levels], "threshold int")).select(*names).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 20
    c = evaluation.false_positives_of(table, 60.0).select("case_id", "threshold", "piece", "voxels").collect()
    e = evaluation.false_positives(truth, found, ("case_id",), keys, 60.0).select("case_id", "threshold", F.col("component").alias("piece"), "voxels").collect()
    assert sorted(map(tuple, c)) == sorted(map(tuple, e)) and c
    small = components.contingency(v.withColumn("pred", F.col("p255") > 0), least=3)
    kept = drop_small(label_components(v.where("p255 > 0")), 3)
    assert small.where("piece is not null").agg(F.sum("n")).first()[0] == kept.count()


def test_levels_of_the_sweep():
    assert [evaluation.level_of(t) for t in evaluation.THRESHOLDS] == [6, 13, 26, 39, 51, 64, 77, 90, 102, 115, 128, 141, 153, 166, 179, 192, 204, 217, 230, 243, 250]


def test_empty_masks_have_no_dice(spark):
    cases = spark.createDataFrame([(1,)], "case_id long")
    none = table(spark, []).select("case_id", "z", "y", "x")
    assert evaluation.case_totals(cases, none, none).first().case_dice is None


def test_scalars(spark):
    one = spark.range(1)
    mm = one.select(fn.diameter(F.lit(4 / 3 * math.pi * 125)).alias("d")).first().d
    assert math.isclose(mm, 10)
    edges = spark.createDataFrame([(v,) for v in (5.0, 5.0001, 10.0, 10.0001, 15.0, 15.0001)], "v double").select(fn.size_bin(F.col("v")).alias("b"))
    assert [r.b for r in edges.collect()] == ["0_5mm", "5_10mm", "5_10mm", "10_15mm", "10_15mm", "gt_15mm"]
    got = one.select(*[fn.intensity(F.lit(v)).alias(f"i{i}") for i, v in enumerate((0.0, 127.5, 255.0))], *[fn.int16(F.lit(v)).alias(f"s{i}") for i, v in enumerate((-1000.4, 39.6, 40000.0))]).first()
    assert tuple(got) == (-200, 0, 200, -1000, 40, 32767)
    low, high = fn.wilson(F.lit(0), F.lit(0))
    assert tuple(one.select(low.alias("a"), high.alias("b")).first()) == (None, None)


def test_target_grid_sizes(spark):
    got = spark.range(1).select(*[volumes.grid_size(F.lit(0), F.lit(n - 1), s, 1.0).alias(a) for a, n, s in (("x", 64, 0.78125), ("y", 32, 0.78125), ("z", 8, 2.5))]).first()
    assert (got.x, got.y, got.z) == (50, 25, 18)


def test_profiles(spark):
    p = [0.0, 0.0, 3.0, 5.0, 6.0, 6.0, 6.0, 6.0, 5.0, 4.0, 0.0]
    df = spark.createDataFrame([(p,)], "p array<double>")
    r = df.select(estimators.trimmed(F.col("p")).alias("t"), estimators.asymmetry(F.col("p")).alias("a"), estimators.interpolated(F.col("p"), 21).alias("i"), estimators.correlation(F.col("p"), F.col("p")).alias("c")).first()
    assert r.t == p[2:10]
    assert math.isclose(r.a, (p[2] - p[0]) / 6 - (p[-3] - p[-1]) / 6)
    assert np.allclose(r.i, np.interp(np.linspace(0, 1, 21), np.linspace(0, 1, 11), p)) and math.isclose(r.c, 1)


def test_registration_choice_and_shift(spark):
    c = spark.createDataFrame([(1, "AP", "centroid", 0.9, 0), (1, "AP", "rigid", 0.9, 1), (1, "AP", "bspline", 0.885, 2), (2, "AP", "centroid", 0.7, 0), (2, "AP", "bspline", 0.6, 2)], "case_id long, phase string, method string, dice double, place int")
    got = {r.case_id: (r.method, r.usable) for r in registration.select_candidate(c).collect()}
    assert got == {1: ("bspline", True), 2: ("centroid", False)}
    one = dict.fromkeys("zyx", 1.0)
    m = spark.createDataFrame([(1, "PVP", 2, 2, 2), (1, "AP", 4, 2, 1), (1, "DP", None, None, None)], "case_id long, phase string, z int, y int, x int")
    s = {r.phase: (r.method, r.dz, r.dx) for r in registration.initial_shifts(m, "PVP", one, dict.fromkeys("zyx", 9)).collect()}
    assert s["AP"] == ("centroid", -2.0, 1.0) and s["DP"][0] == "geometry_centre"
    g = registration.smoothed(table(spark, cube(1, 2, 3)), 1.0, one, dict.fromkeys("zyx", 7)).collect()
    assert math.isclose(max(r.value for r in g), next(r.value for r in g if (r.z, r.y, r.x) == (3, 3, 3)))


def test_taxonomy(spark):
    got = {r.diagnosis: r for r in taxonomy.labelled(spark.createDataFrame([("CN",), ("CHCC",), ("BCLM",)], "diagnosis string")).collect()}
    assert got["CN"].behavior_id == -1 and got["CHCC"].diagnosis_fine == "cHCC-CCA" and got["BCLM"].diagnosis_coarse == "metastasis"
    with pytest.raises(records.MissingRows):
        taxonomy.labelled(spark.createDataFrame([("XYZ",), (None,)], "diagnosis string"))


def test_label_schema():
    doc = taxonomy.schema()
    h = doc["hierarchies"]
    assert h["lesion_presence"] == {"absent": 0, "present": 1} and h["behavior"] == {"not_applicable": -1, "benign": 0, "malignant": 1}
    assert h["origin"] == {"not_applicable": -1, "primary_hepatic": 0, "extrahepatic_metastatic": 1}
    assert h["diagnosis_coarse"] == {"control": 0, "HH": 1, "HCC": 2, "ICC": 3, "cHCC-CCA": 4, "metastasis": 5}
    assert h["diagnosis_fine"] == {"CN": 0, "HH": 1, "HCC": 2, "ICC": 3, "cHCC-CCA": 4, "CRLM": 5, "BCLM": 6}
    assert doc["diagnosis_mapping"]["CHCC"] == "cHCC-CCA"


def test_components_are_numbered_without_gaps(spark):
    found = label_components(table(spark, cube(1, 0, 1) + cube(1, 3, 2) + cube(1, 8, 2) + cube(2, 0, 2)))
    rows = components.numbered(drop_small(found, 2)).collect()
    assert {(r.case_id, r.label): sum(x.label == r.label and x.case_id == r.case_id for x in rows) for r in rows} == {(1, 1): 8, (1, 2): 8, (2, 1): 8}


def test_totals_of_marks_equal_those_of_masks(spark):
    rng = random.Random(4)
    rows = [(c, z, y, x, rng.random() < 0.3, rng.random() < 0.3) for c in (1, 2) for z in range(3) for y in range(3) for x in range(3)] + [(3, 0, 0, 0, False, False)]
    v = spark.createDataFrame(rows, "case_id long, z int, y int, x int, gt boolean, pred boolean")
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "case_id long")
    a, b = (sorted(map(tuple, f.collect())) for f in (evaluation.case_totals_marked(cases, v), evaluation.case_totals(cases, v.where("gt"), v.where("pred"))))
    assert a == b and a[2][-1] is None


def test_merge_is_strict(spark):
    m = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, name string, v string")
    u = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, records.merged(m, u, ["k"]).collect())) == [(1, "a", "x"), (2, "b", "y")]
    with pytest.raises(records.MissingRows):
        records.merged(m, u.where("k <> 2"), ["k"])
    with pytest.raises(ValueError, match="more than one"):
        records.merged(m, u.union(u), ["k"])


def test_stale_records_are_refused(spark):
    rows = [("A", "1", True), ("A", "0", True), ("A", None, True), ("B", "0", True), ("A", "0", False)]
    df = spark.createDataFrame(rows, "dataset string, pipeline_version string, complete boolean")
    assert records.stale(df, "1", ["B"], F.col("complete")).count() == 2
    with pytest.raises(records.StaleRecords, match="2 records"):
        records.refuse_stale(df, "1", ["B"], F.col("complete"))
    assert records.refuse_stale(df, "1", ["A", "B"]).count() == 5


def grid(spark, rows):
    return spark.createDataFrame(rows, "case_id long, size array<int>, spacing_mm array<double>, origin_mm array<double>")


def test_geometry_is_applied(spark):
    v = spark.createDataFrame([(c, z, 0, 0, float(z)) for c in (1, 2, 3) for z in range(4)], "case_id long, z int, y int, x int, value double")
    heads = grid(spark, [(c, [1, 1, 4], [1.0, 1.0, 5.0], [0.0] * 3) for c in (1, 2, 3)])
    known = spark.createDataFrame([(1, [0.78, 0.78, 2.0], True), (2, [0.78, 0.78, 3.0], False)], "case_id long, spacing_mm array<double>, k_axis_flip boolean")
    rows, out = volumes.apply_geometry(v, heads, known)
    assert {r.case_id: r.spacing_mm[2] for r in out.collect()} == {1: 2.0, 2: 3.0, 3: 5.0}
    assert {(r.case_id, r.z): r.value for r in rows.collect()} == {(c, 3 - z if c == 1 else z): float(z) for c in (1, 2, 3) for z in range(4)}


@pytest.mark.parametrize("seed", range(3))
def test_align_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    own, ref = ([rng.randint(3, 7) for _ in range(3)] for _ in range(2))
    gs, rs = ([rng.choice([0.5, 1.0, 1.5, 2.5]) for _ in range(3)] for _ in range(2))
    go, ro = ([rng.choice([-1.0, 0.0, 0.75]) for _ in range(3)] for _ in range(2))
    mask = {(z, y, x) for z in range(own[2]) for y in range(own[1]) for x in range(own[0]) if rng.random() < 0.4}
    nearest = lambda k, a: math.floor((ro[a] + k * rs[a] - go[a]) / gs[a] + 0.5)
    want = {(z, y, x) for z in range(ref[2]) for y in range(ref[1]) for x in range(ref[0]) if (nearest(z, 2), nearest(y, 1), nearest(x, 0)) in mask}
    m = spark.createDataFrame([(1, *p) for p in mask], "case_id long, z int, y int, x int")
    rows = volumes.align(m, grid(spark, [(1, own, gs, go)]), grid(spark, [(1, ref, rs, ro)])).collect()
    assert len(rows) == len(want) and {(r.z, r.y, r.x) for r in rows} == want
    assert {tuple(r)[1:] for r in volumes.align(m, grid(spark, [(1, own, gs, go)]), grid(spark, [(1, own, gs, go)])).collect()} == mask


def test_fallback_mask_lies_as_the_volume_is_stored(spark):
    seg = spark.createDataFrame([(c, z, 1, 1, v) for c in (1, 2) for z, v in ((0, 5.0), (1, 5.0), (2, 6.0))], "case_id long, z int, y int, x int, value double")
    g = grid(spark, [(c, [3, 3, 4], [1.0] * 3, [0.0] * 3) for c in (1, 2)])
    flips = spark.createDataFrame([(1, True), (2, False)], "case_id long, flip boolean")
    mask, profile = volumes.fallback_mask(seg, g, g, 5, flips)
    assert {(r.case_id, r.z) for r in mask.collect()} == {(1, 3), (1, 2), (2, 0), (2, 1)}
    assert {r.case_id: (r.slices, r.first, r.last, r.z_extent) for r in profile.collect()} == {1: (2, 2, 3, 2), 2: (2, 0, 1, 2)}


def test_smoothing_equals_convolution(spark):
    size, spacing = {"z": 6, "y": 9, "x": 7}, {"z": 2.0, "y": 1.0, "x": 1.0}
    v = np.zeros((6, 9, 7))
    v[2:4, 5:9, 0:2] = 1
    want = v
    for axis, s in enumerate((0.75, 1.5, 1.5)):
        k = registration.kernel(s)
        want = np.apply_along_axis(lambda line, k=k: np.convolve(np.pad(line, len(k) // 2, mode="edge"), k, "valid"), axis, want)
    mask = spark.createDataFrame([(1, *map(int, p)) for p in zip(*np.nonzero(v), strict=True)], "case_id long, z int, y int, x int")
    got = np.zeros_like(v)
    for r in registration.smoothed(mask, 1.5, spacing, size).collect():
        got[r.z, r.y, r.x] = r.value
    assert np.allclose(got, want, atol=2e-6)


def test_shift_between_grid_centres(spark):
    m = spark.createDataFrame([(1, "PVP", 2, 2, 2), (1, "AP", None, None, None)], "case_id long, phase string, z int, y int, x int")
    sizes = spark.createDataFrame([(1, "PVP", 11, 5, 5), (1, "AP", 21, 5, 5)], "case_id long, phase string, z int, y int, x int")
    s = {r.phase: (r.method, r.dz) for r in registration.initial_shifts(m, "PVP", {"z": 2.0, "y": 1.0, "x": 1.0}, sizes).collect()}
    assert s == {"PVP": ("centroid", 0.0), "AP": ("geometry_centre", -10.0)}


def test_candidates_without_dice(spark):
    rows = [(1, "AP", "centroid", None, 0), (1, "AP", "rigid", None, 1), (2, "AP", "rigid", None, 1), (2, "AP", "bspline", 0.3, 2), (3, "AP", "bspline", 0.9, 2), (4, "AP", "affine", 0.85, 2), (4, "AP", "bspline", None, 3), (5, "AP", "rigid", 0.9, 1), (5, "AP", "bspline", 0.879, 2)]
    c = spark.createDataFrame(rows, "case_id long, phase string, method string, dice double, place int")
    got = {r.case_id: (r.method, r.dice, r.usable) for r in registration.select_candidate(c).collect()}
    assert got == {1: ("centroid", None, False), 2: ("bspline", 0.3, False), 3: ("bspline", 0.9, True), 4: ("affine", 0.85, True), 5: ("rigid", 0.9, True)}
