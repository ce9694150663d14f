"""Trilinear resampling: what it moves, and its values against a plain version."""

import itertools
import math

import pytest

from voxcohort.operators import volumes
from voxcohort.plans import QUERIES, SQL

from .oracle import check

VOXELS = "case_id long, z int, y int, x int, value double"


def plain(values, counts, steps, fill):
    out = {}
    for p in itertools.product(*map(range, counts)):
        total = 0.0
        for d in itertools.product((0, 1), repeat=3):
            at = [i * s for i, s in zip(p, steps, strict=True)]
            w = math.prod(a - math.floor(a) if up else 1 - (a - math.floor(a)) for a, up in zip(at, d, strict=True))
            v = values.get(tuple(math.floor(a) + up for a, up in zip(at, d, strict=True)))
            if w > 0:
                total = None if v is None or total is None else total + w * v
        out[p] = fill if total is None else total
    return out


@pytest.mark.parametrize("counts, steps", [((4, 6, 3), (0.7, 0.3, 1.3)), ((2, 3, 5), (2.0, 1.0, 0.75)), ((9, 2, 2), (0.1, 3.4, 2.5))])
def test_points_between_voxels(spark, counts, steps):
    """Case 2 lacks a voxel and has an empty one, case 3 has none, case 4 is not asked for."""
    whole = {(z, y, x): float(z * z + 3 * y + 7 * x % 5) for z in range(4) for y in range(5) for x in range(5)}
    holed = whole | {(1, 1, 1): None}
    del holed[0, 2, 2]
    volume = spark.createDataFrame([(c, *p, v) for c, g in ((1, whole), (2, holed), (4, whole)) for p, v in g.items()], VOXELS)
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    named = lambda v: dict(zip("zyx", v, strict=True))
    rows = volumes.resample_linear(volume, cases, named(counts), named(steps), -1000.0).collect()
    got = {(r.case_id, r.z, r.y, r.x): r.value for r in rows}
    want = {(c, *p): v for c, g in ((1, whole), (2, holed), (3, {})) for p, v in plain(g, counts, steps, -1000.0).items()}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three volumes; the second has a voxel twice in place of its neighbour, and one without a value."""
    d = tmp_path_factory.mktemp("events")
    rows = [(1554 if i == 1555 else i, "view", None if i == 1333 else i * 37 % 101 / 4, 0) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, user_id long").coalesce(1).write.parquet(f"{d}/events.parquet")
    return str(d)


def test_voxels_twice_and_without_value(spark, events):
    check(spark, events, QUERIES["resample_linear"], SQL["resample_linear"])


def test_points_are_moved_not_corners(spark, events):
    """Two rows a point go through shuffles, its sum and itself, not its corners."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES["resample_linear"](spark, events)
        points = len(df.collect())
        found, nodes = [], [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert points == 3 * 14 * 13 * 13 and sum(found) <= 2 * points + 10
