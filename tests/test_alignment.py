"""Mask registration, segmentation by a model that is handed in, and the choice among its passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.operators import alignment as A
from voxcohort.operators import registration
from voxcohort.operators import segmentation as G

SPACING = {"z": 2.0, "y": 1.5, "x": 1.5}
SIZE = {"z": 30, "y": 40, "x": 40}
MM = np.array([2.0, 1.5, 1.5])


def ellipsoid(matrix=np.eye(3), shift=(0, 0, 0)):
    """Voxels of a body without symmetry; the moving one is its image under p -> matrix (p - c) + c + shift."""
    grid = np.stack(np.meshgrid(*[np.arange(SIZE[a]) for a in "zyx"], indexing="ij"), axis=-1).reshape(-1, 3)
    c = np.array([30.0, 30.0, 30.0])
    p = np.linalg.solve(matrix, (grid * MM - c - np.array(shift)).T).T
    body = (p / np.array([12.0, 9.0, 16.0])) ** 2
    bump = ((p - np.array([6.0, 7.0, 6.0])) / 7.0) ** 2
    return grid[(body.sum(axis=1) <= 1) | (bump.sum(axis=1) <= 1)]


def test_turn_is_a_rotation():
    r = A.turn(np.array([0.3, -0.2, 0.5]))
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1) and np.allclose(A.turn(np.zeros(3)), np.eye(3))
    assert np.allclose(A.turn(np.array([np.pi / 2, 0, 0])) @ [0, 1, 0], [0, 0, 1])


def test_samples_are_linear_between_voxels():
    z, y, x = np.meshgrid(np.arange(4), np.arange(5), np.arange(3), indexing="ij")
    at = np.array([[0.5, 3.0, 2.25, -0.1], [1.5, 4.0, 0.0, 1.0], [1.25, 2.0, 0.75, 1.0]])
    value, slope = A.sampled((2.0 * z - y + 3 * x).astype(np.float32), at)
    assert np.allclose(value, [2 * 0.5 - 1.5 + 3.75, 6 - 4 + 6, 4.5 + 2.25, 0]) and np.allclose(slope[:, 0], [2, -1, 3]) and not slope[:, 3].any()


@pytest.mark.parametrize("rigid", [True, False])
def test_known_transforms_are_found(rigid):
    truth = A.turn(np.array([0.15, -0.1, 0.1])) if rigid else np.diag([1.1, 0.95, 1.0])
    fixed, moving = ellipsoid(), ellipsoid(truth, (5.0, -4.0, 3.0))
    matrix, shift, centre = A.fitted(fixed, moving, MM, rigid)
    assert np.allclose(matrix, truth, atol=0.04)
    carried = truth @ (centre - 30.0) + 30.0 + np.array([5.0, -4.0, 3.0])
    assert np.allclose(centre + shift, carried, atol=0.4)
    size, start = np.array(list(SIZE.values())), moving.mean(axis=0) * MM - centre
    before, after = (A.overlap(fixed, moving, MM, size, *t) for t in ((np.eye(3), start, centre), (matrix, shift, centre)))
    assert after > before and after > 0.93


def plain_dice(fixed, moving, size, matrix, shift, centre):
    held, there = {tuple(v) for v in moving}, set()
    for v in np.ndindex(*size):
        q = matrix @ (np.array(v) * MM - centre) + centre + shift
        if tuple(np.floor(q / MM + 0.5).astype(int)) in held:
            there.add(v)
    own = {tuple(v) for v in fixed}
    return 2 * len(own & there) / (len(own) + len(there))


def test_overlap_against_every_voxel():
    size, r = (8, 9, 7), np.random.default_rng(5)
    for _ in range(5):
        fixed, moving = (np.unique(r.integers(0, size, (60, 3)), axis=0) for _ in range(2))
        t = A.turn(r.normal(0, 0.3, 3)) @ np.diag(r.uniform(0.8, 1.2, 3)), r.normal(0, 2, 3), np.array([7.0, 6.0, 4.0])
        assert np.isclose(A.overlap(fixed, moving, MM, np.array(size), *t), plain_dice(fixed, moving, size, *t))
    far = np.eye(3), np.full(3, 1000.0), np.zeros(3)
    assert A.overlap(fixed, moving, MM, np.array(size), *far) == 0


def test_candidates_and_choice(spark):
    rows = [(c, p, *map(int, v)) for c, p, m in (("a", "PVP", ellipsoid()), ("a", "AP", ellipsoid(np.eye(3), (4.0, 0, -3.0))), ("a", "NC", ellipsoid(np.diag([1.4, 1, 1]))), ("b", "AP", ellipsoid()[:50]), ("c", "PVP", ellipsoid()[:50])) for v in m]
    rows += [("b", "PVP", None, None, None), ("c", "AP", None, None, None)]
    masks = spark.createDataFrame(rows, "case_id string, phase string, z int, y int, x int").repartition(5)
    found = A.candidates(masks, "PVP", SPACING, SIZE, lambda best, *rest: 0.5 if best[0] == "centroid" else None)
    got = {}
    for r in found.collect():
        got.setdefault((r.case_id, r.phase), {})[r.method] = r
    assert {k: set(v) - {"centroid_bspline"} for k, v in got.items()} == {("a", "AP"): {"centroid", "rigid", "affine"}, ("a", "NC"): {"centroid", "rigid"}, ("b", "AP"): {"geometry_centre"}, ("c", "AP"): {"geometry_centre"}}
    assert got["a", "AP"]["rigid"].dice > 0.97 and got["b", "AP"]["geometry_centre"].dice is None
    assert ("centroid_bspline" in got["a", "AP"]) == (got["a", "AP"]["centroid"].dice >= max(got["a", "AP"][m].dice for m in ("rigid", "affine")))
    usable = {(r.case_id, r.phase): r.usable for r in registration.select_candidate(found).collect()}
    assert usable["a", "AP"] and not usable["b", "AP"] and not usable["c", "AP"]
    assert A.candidates(masks.limit(0), "PVP", SPACING, SIZE).count() == 0


def test_model_grid():
    v = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    same = G.model_grid(v, [3.0, 3.0, 3.0])
    assert (same == v[:, ::-1, ::-1]).all()
    fine = G.model_grid(v, [6.0, 3.0, 3.0])
    assert fine.shape == (4, 3, 4) and (fine[1] == (v[0] + v[1])[::-1, ::-1] / 2).all() and (fine[3] == G.OUTSIDE).all()


def test_segmented_by_a_model(spark):
    rows = [(c, z, y, x, float(10 * z + y)) for c in ("a", "b") for z in range(4) for y in range(3) for x in range(2)]
    volume = spark.createDataFrame([*rows, ("no grid", 0, 0, 0, 1.0)], "case_id string, z int, y int, x int, value double")
    grids = spark.createDataFrame([("a", [2, 3, 4], [3.0, 3.0, 3.0]), ("b", [2, 3, 4], [3.0, 3.0, 1.5]), ("empty", [2, 2, 2], [3.0, 3.0, 3.0])], "case_id string, size array<int>, spacing_mm array<double>")
    got = {(r.case_id, r.z, r.y, r.x): r.label for r in G.segmented(volume, grids, lambda v: np.where(v > 15, 1 + (v > 25), 0)).collect()}
    own = {("a", z, 2 - y, x): 1 + (10 * z + y > 25) for z in range(4) for y in range(3) for x in range(2) if 10 * z + y > 15}
    half = {("b", 1, 2 - y, x): 1 for y in range(3) for x in range(2)}
    assert got == own | half


def test_guesses(spark):
    rows = [(85, 100), (7, 100), (20, 100), (39, 50), (10, 1000), (0, 0)]
    df = spark.createDataFrame(rows, "m long, v long")
    got = [(round(r[0], 4), r[1], round(r[2], 4), r[3]) for r in df.coalesce(1).select(*G.guesses(F.col("m"), F.col("v"))).collect()]
    # 170 / 85; too few slices; 8.5 is cut to 7 and 20 of 100 slices are few; 39 of 50 are not; 0.177 is cut to 0.4.
    assert got == [(2.0, G.BY_MASK, 1.7708, False), (1.7708, G.BY_VOLUME, 1.7708, False), (7.0, G.BY_MASK, 1.7708, True), (4.359, G.BY_MASK, 3.5417, False), (7.0, G.BY_MASK, 0.4, True), (7.0, G.BY_VOLUME, 7.0, False)]


def test_consistency_of_levels(spark):
    rows = [("up", "L2", 1.0), ("up", "L1", 2.0), ("up", "T12", 3.0), ("up", "T8", 4.0), ("down", "T10", 1.0), ("down", "T11", 2.0), ("down", "L4", 3.0), ("tie", "L1", 1.0), ("tie", "T12", 1.0), ("none", "C7", 1.0)]
    got = {r.k: tuple(r)[1:] for r in G.consistency(spark.createDataFrame(rows, "k string, level string, z double"), ["k"]).collect()}
    assert got == {"up": (6, 3, 4), "down": (-3, 2, 3), "tie": (0, 2, 2)}


def test_choice_among_passes(spark):
    passes = [("sure", "first", 6, 4, 4), ("second", "first", 1, 2, 3), ("second", "second", 6, 4, 4), ("tie", "first", 1, 2, 3), ("tie", "second", 1, 2, 3), ("more", "first", 1, 2, 3), ("more", "second", 1, 2, 4)]
    passes += [("turned", "first", 0, 2, 3), ("turned", "other", 0, 3, 3), ("same", "first", 2, 3, 3), ("same", "other", 2, 3, 9), ("sure", "other", 9, 9, 9), ("fallen", "first", -1, 1, 2), ("void", "first", -1, 1, 2), ("void", "other", None, None, None)]
    names = ["sure", "second", "tie", "more", "turned", "same", "fallen", "void", "none"]
    decided = spark.createDataFrame([(n, True, "liver_profile") for n in names], "k string, flip boolean, source string")
    got = {r.k: (r.chosen, r.flip, r.source.removeprefix("liver_profile+"), r.levels) for r in G.chosen_pass(spark.createDataFrame(passes, "k string, kind string, order_score long, plausible long, levels long"), decided, ["k"]).collect()}
    assert got == {
        "sure": ("first", True, G.SURE, 4), "second": ("second", True, G.SURE, 4), "tie": ("first", True, G.WEAKLY, 3), "more": ("second", True, G.WEAKLY, 4),
        "turned": ("other", False, G.OVERRIDE, 3), "same": ("first", True, G.WEAKLY, 3), "fallen": ("first", True, G.NOT, 2), "void": ("other", False, G.OVERRIDE, 0), "none": ("first", True, G.NOT, 0),
    }


def test_masks_of_a_voxel_or_a_line():
    size = np.array(list(SIZE.values()))
    for fixed, moving in (([[5, 5, 5]], [[9, 8, 7]]), ([[0, 0, 0]], [[29, 39, 39]]), ([[i, 5, 5] for i in range(9)], [[i + 3, 6, 5] for i in range(9)])):
        fixed, moving = np.array(fixed), np.array(moving)
        assert A.overlap(fixed, moving, MM, size, *A.fitted(fixed, moving, MM, True)) == 1
