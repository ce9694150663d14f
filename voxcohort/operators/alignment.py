"""Registration of masks: rigid and affine transforms that bring smoothed masks together, scored by their overlap.

Squared differences of the smoothed masks are made least by damped Gauss-Newton steps over three resolutions. It is not
the optimiser of any other package, so transforms agree with those of another only as far as both find the same optimum.
A deformable method can be handed in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import AXIS_SCALE
from .registration import AXES, blurred

# Smoothing of masks in mm; shrink factors and further smoothing in mm of the resolutions.
SOFT, SHRINK, FURTHER = 4.0, (4, 2, 1), (8.0, 4.0, 0.0)
STEPS = 30

#: What a candidate is; matrix by rows, shift and centre in mm, z before y before x.
CANDIDATE = "method string, place int, dice double, matrix array<double>, shift array<double>, centre array<double>, scales array<double>"


def sampled(volume: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (n) and gradients (3, n) by voxel of `volume` at voxel coordinates (3, n); 0 outside. Every axis has two voxels."""
    last = np.array(volume.shape)[:, None] - 1
    inside = ((at >= 0) & (at <= last)).all(axis=0)
    low = np.clip(np.floor(at), 0, last - 1).astype(np.int64)
    part = np.where(inside, at - low, 0.0)
    value, slope = np.zeros(at.shape[1]), np.zeros(at.shape)
    for corner in np.ndindex(2, 2, 2):
        here = volume[tuple(low[i] + c for i, c in enumerate(corner))]
        share = [part[i] if c else 1 - part[i] for i, c in enumerate(corner)]
        value += here * share[0] * share[1] * share[2]
        for i, c in enumerate(corner):
            j, k = (a for a in range(3) if a != i)
            slope[i] += here * (1 if c else -1) * share[j] * share[k]
    return value * inside, slope * inside


class Soft:
    """A mask smoothed within the box that it can reach; `origin` is that box's corner in voxels of the grid."""

    def __init__(self, voxels: np.ndarray, spacing: np.ndarray, sigma: float):
        reach = np.ceil(4 * sigma / spacing).astype(np.int64) + 1
        self.origin, self.spacing = voxels.min(axis=0) - reach, spacing
        box = np.zeros(voxels.max(axis=0) + reach + 1 - self.origin, dtype=np.float32)
        box[tuple((voxels - self.origin).T)] = 1
        self.values = blurred(box, list(sigma / spacing))

    def at(self, mm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, slope = sampled(self.values, mm / self.spacing[:, None] - self.origin[:, None])
        return value, slope / self.spacing[:, None]

    def points(self, shrink: int) -> np.ndarray:
        """Each `shrink`-th voxel of the box, in mm (3, n)."""
        at = np.stack(np.meshgrid(*[np.arange(0, n, shrink) for n in self.values.shape], indexing="ij")).reshape(3, -1)
        return (at + self.origin[:, None]) * self.spacing[:, None]


def turn(w: np.ndarray) -> np.ndarray:
    """The rotation by |w| radians about w."""
    angle = float(np.linalg.norm(w))
    if angle < 1e-12:
        return np.eye(3)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / angle
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def fitted(fixed: np.ndarray, moving: np.ndarray, spacing: np.ndarray, rigid: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, shift, centre) that carry fixed points p to matrix (p - centre) + centre + shift in the moving volume. Starts
    at the centroids' distance; a step that makes the difference larger is taken back and damped."""
    centre = fixed.mean(axis=0) * spacing
    matrix, shift, damping = np.eye(3), moving.mean(axis=0) * spacing - centre, 1e-3
    for shrink, further in zip(SHRINK, FURTHER, strict=True):
        sigma = float(np.hypot(SOFT, further))
        f, m = Soft(fixed, spacing, sigma), Soft(moving, spacing, sigma)
        points = f.points(shrink)
        target, away = f.at(points)[0], points - centre[:, None]
        place = lambda a, t: a @ away + (centre + t)[:, None]
        value, slope = m.at(place(matrix, shift))
        cost = float(((target - value) ** 2).sum())
        for _ in range(STEPS):
            carried = matrix @ away
            if rigid:
                by_turn = np.stack([carried[1] * slope[2] - carried[2] * slope[1], carried[2] * slope[0] - carried[0] * slope[2], carried[0] * slope[1] - carried[1] * slope[0]])
                j = np.concatenate([by_turn, slope])
            else:
                j = np.concatenate([(slope[:, None] * away[None]).reshape(9, -1), slope])
            normal, wanted = j @ j.T, j @ (target - value)
            step = np.linalg.lstsq(normal + damping * np.diag(np.diag(normal)), wanted, rcond=None)[0]
            tried = (turn(step[:3]) @ matrix if rigid else matrix + step[:9].reshape(3, 3)), shift + step[-3:]
            found = m.at(place(*tried))
            now = float(((target - found[0]) ** 2).sum())
            if now < cost:
                gain, cost, damping = cost - now, now, max(damping / 3, 1e-9)
                (matrix, shift), (value, slope) = tried, found
                if gain <= 1e-7 * max(cost, 1e-12):
                    break
            else:
                damping *= 4
                if damping > 1e6:
                    break
        damping = 1e-3
    return matrix, shift, centre


def overlap(fixed: np.ndarray, moving: np.ndarray, spacing: np.ndarray, size: np.ndarray, matrix: np.ndarray, shift: np.ndarray, centre: np.ndarray) -> float:
    """Dice of the fixed mask and the moving one brought onto its grid (nearest voxel); 1 if both are empty there."""
    corners = np.array(list(np.ndindex(2, 2, 2))).T
    box = (moving.min(axis=0) - 1)[:, None] + corners * (np.ptp(moving, axis=0) + 2)[:, None]
    back = np.linalg.solve(matrix, box * spacing[:, None] - (centre + shift)[:, None]) + centre[:, None]
    low = np.maximum(np.floor(back.min(axis=1) / spacing).astype(np.int64), 0)
    high = np.minimum(np.ceil(back.max(axis=1) / spacing).astype(np.int64) + 1, size)
    warped = np.zeros((0, 3), dtype=np.int64)
    if (high > low).all():
        held = np.zeros(np.ptp(moving, axis=0) + 1, dtype=bool)
        held[tuple((moving - moving.min(axis=0)).T)] = True
        grid = np.stack(np.meshgrid(*[np.arange(a, b) for a, b in zip(low, high, strict=True)], indexing="ij")).reshape(3, -1)
        there = matrix @ (grid * spacing[:, None] - centre[:, None]) + (centre + shift)[:, None]
        there = np.floor(there / spacing[:, None] + 0.5).astype(np.int64) - moving.min(axis=0)[:, None]
        inside = ((there >= 0) & (there < np.array(held.shape)[:, None])).all(axis=0)
        hit = np.zeros(len(inside), dtype=bool)
        hit[inside] = held[tuple(there[:, inside])]
        warped = grid[:, hit].T
    code = lambda v: np.ravel_multi_index(tuple(v.T), tuple(size))
    both, total = len(np.intersect1d(code(fixed), code(warped))), len(fixed) + len(warped)
    return 2.0 * both / total if total else 1.0


def candidates(masks: DataFrame, reference: str, spacing: dict[str, float], size: dict[str, int], deformable: Callable | None = None) -> DataFrame:
    """(case_id, phase, CANDIDATE) for `registration.select_candidate`: how each phase's mask is brought to the reference's.

    `masks`: case_id, phase and distinct coordinates on grids of one spacing and size, null for a phase without a mask. Methods
    are `centroid`, `rigid` and `affine`; an affine one whose axis scales leave AXIS_SCALE is left out. Where a mask of the
    pair is empty, the only one is `geometry_centre`, without a Dice. `deformable`: called with the best of these (its method,
    matrix, shift, centre), the fixed and the moving voxels, spacing and size, gives the Dice of its own result, or None; it
    becomes `<method>_bspline`. One pair of phases a task; only the boxes that the masks reach are dense.
    """
    mm, whole = np.array([spacing[a] for a in AXES], dtype=np.float64), np.array([size[a] for a in AXES])
    kind = dict(masks.dtypes)["case_id"]

    def found(fixed: np.ndarray, moving: np.ndarray) -> list[tuple]:
        if not len(fixed) or not len(moving):
            return [("geometry_centre", None, np.eye(3), np.zeros(3), (whole - 1) * mm / 2)]
        start = fixed.mean(axis=0) * mm
        tried = [("centroid", np.eye(3), moving.mean(axis=0) * mm - start, start), ("rigid", *fitted(fixed, moving, mm, True)), ("affine", *fitted(fixed, moving, mm, False))]
        scored = [(name, overlap(fixed, moving, mm, whole, *t), *t) for name, *t in tried if name != "affine" or all(AXIS_SCALE[0] <= s <= AXIS_SCALE[1] for s in np.linalg.norm(t[0], axis=0))]
        if deformable is not None:
            best = max(scored, key=lambda c: c[1])  # the first of equals
            dice = deformable((best[0], *best[2:]), fixed, moving, mm, whole)
            scored += [(f"{best[0]}_bspline", float(dice), *best[2:])] if dice is not None else []
        return scored

    def run(key: tuple, moving: pa.Table, fixed: pa.Table) -> pa.Table:
        grid = lambda t: np.stack([t.column(a).to_numpy() for a in AXES], axis=1).astype(np.int64)
        rows = found(grid(fixed.drop_null()), grid(moving.drop_null()))
        flat = [{"method": name, "place": i, "dice": dice, "matrix": m.ravel().tolist(), "shift": t.tolist(), "centre": c.tolist(), "scales": np.linalg.norm(m, axis=0).tolist()} for i, (name, dice, m, t, c) in enumerate(rows)]
        names = {n: pa.array([key[i].as_py()] * len(flat), moving.schema.field(n).type) for i, n in enumerate(("case_id", "phase"))}
        columns = {n: pa.array([r[n] for r in flat], t) for n, t in (("method", pa.string()), ("place", pa.int32()), ("dice", pa.float64()), *[(n, pa.list_(pa.float64())) for n in ("matrix", "shift", "centre", "scales")])}
        return pa.table(names | columns)

    rows = masks.select("case_id", "phase", *[F.col(a).cast("int").alias(a) for a in AXES])
    moving = rows.where(F.col("phase") != reference)
    asked = moving.select(F.col("case_id").alias("for_case"), F.col("phase").alias("for_phase")).distinct()
    base = rows.where(F.col("phase") == reference).select(F.col("case_id").alias("for_case"), *[F.col(a).alias(a) for a in AXES])
    fixed = asked.join(base, "for_case")  # a copy for each phase of the case
    return moving.groupBy("case_id", "phase").cogroup(fixed.groupBy("for_case", "for_phase")).applyInArrow(run, f"case_id {kind}, phase string, {CANDIDATE}")
