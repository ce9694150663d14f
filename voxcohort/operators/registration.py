"""Alignment of phases: initial shifts from mask moments, smoothed masks, choice among candidates, and the gate.

Iterative optimisers are external; candidates with their Dice come as a table from whatever ran them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DICE_GATE

AXES = ("z", "y", "x")


def initial_shifts(masks: DataFrame, reference: str, spacing: dict[str, float], size: dict[str, int] | DataFrame) -> DataFrame:
    """(case_id, phase, method, dz, dy, dx) in mm: from centroid to centroid, or between grid centres where a mask of the
    pair is empty. `masks`: case_id, phase, and coordinates that may be null. `size`: of all grids, so that their centres
    coincide, or a table (case_id, phase, z, y, x) of each phase's."""
    centres = masks.groupBy("case_id", "phase").agg(*[F.avg(F.col(a) * spacing[a]).alias(a) for a in AXES])
    if isinstance(size, DataFrame):
        middle = size.select("case_id", "phase", *[((F.col(a) - 1) * spacing[a] / 2.0).alias(f"m{a}") for a in AXES])
    else:
        middle = centres.select("case_id", "phase", *[F.lit((size[a] - 1) * spacing[a] / 2.0).alias(f"m{a}") for a in AXES])
    centres = centres.join(middle, ["case_id", "phase"])
    base = centres.where(F.col("phase") == reference).select("case_id", *[F.col(f"{k}{a}").alias(f"r{k}{a}") for a in AXES for k in ("", "m")])
    both = centres.join(base, "case_id", "left")
    found = F.col("z").isNotNull() & F.col("rz").isNotNull()
    shift = [F.when(found, F.col(f"r{a}") - F.col(a)).otherwise(F.coalesce(F.col(f"rm{a}") - F.col(f"m{a}"), F.lit(0.0))).alias(f"d{a}") for a in AXES]
    return both.select("case_id", "phase", F.when(found, "centroid").otherwise("geometry_centre").alias("method"), *shift)


def select_candidate(candidates: DataFrame, rich: str = "bspline", tolerance: float = 0.02, keys: tuple[str, ...] = ("case_id", "phase")) -> DataFrame:
    """(keys, method, dice, usable): the best candidate by Dice, ties to the earlier `place`; `rich` wins if it is within
    `tolerance` of the best of the others. `usable` is the quality gate; no Dice does not pass it. One aggregate."""
    order = F.struct(F.coalesce("dice", F.lit(-1.0)).alias("d"), (-F.col("place")).alias("p"))
    pick = lambda where, name: F.max_by(F.when(where, F.struct("method", "dice")), F.when(where, order)).alias(name)
    g = candidates.groupBy(*keys).agg(pick(F.col("method") != rich, "base"), pick(F.col("method") == rich, "fine"))
    near = F.col("base").isNull() | F.coalesce(F.col("fine.dice") >= F.coalesce("base.dice", F.lit(0.0)) - tolerance, F.lit(False))
    chosen = g.withColumn("chosen", F.when(F.col("fine").isNotNull() & near, F.col("fine")).otherwise(F.col("base")))
    return chosen.select(*keys, "chosen.method", "chosen.dice", F.coalesce(F.col("chosen.dice") >= DICE_GATE, F.lit(False)).alias("usable"))


def kernel(sigma: float) -> np.ndarray:
    """Weights of a Gaussian of `sigma` voxels, four deviations to each side."""
    reach = int(np.ceil(4 * sigma))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return k / k.sum()


def blurred(volume: np.ndarray, sigmas: list[float]) -> np.ndarray:
    """Gaussian along each axis in turn, edges repeated: a sum of shifted volumes, a shift for each weight."""
    for axis, sigma in enumerate(sigmas):
        k = kernel(sigma)
        n, reach = volume.shape[axis], len(k) // 2
        padded = np.pad(volume, [(reach, reach) if i == axis else (0, 0) for i in range(volume.ndim)], mode="edge")
        out = np.zeros_like(volume)
        for i, w in enumerate(k):
            out += w * padded[(slice(None),) * axis + (slice(i, i + n),)]
        volume = out
    return volume


def smoothed(mask: DataFrame, sigma_mm: float, spacing: dict[str, float], size: dict[str, int], precision: type = np.float32) -> DataFrame:
    """Gaussian of each case's mask over its grid (case_id, z, y, x, value), values over 1e-6. One case a task; only the
    box that the mask can reach is dense, in `precision`."""
    sigmas = [sigma_mm / spacing[a] for a in AXES]
    reach = np.array([int(np.ceil(4 * s)) for s in sigmas])
    whole = np.array([size[a] for a in AXES])
    kind = dict(mask.dtypes)["case_id"]

    def run(table: pa.Table) -> pa.Table:
        at = np.stack([table.column(a).to_numpy() for a in AXES], axis=1).astype(np.int64)
        low, high = np.maximum(at.min(axis=0) - reach, 0), np.minimum(at.max(axis=0) + reach + 1, whole)
        v = np.zeros(high - low, dtype=precision)
        v[tuple((at - low).T)] = 1
        v = blurred(v, sigmas)
        found = np.nonzero(v > 1e-6)
        columns = {a: pa.array((f + low[i]).astype(np.int32)) for i, (a, f) in enumerate(zip(AXES, found, strict=True))}
        case = pa.array([table.column("case_id")[0].as_py()] * len(found[0]), table.schema.field("case_id").type)
        return pa.table({"case_id": case, **columns, "value": pa.array(v[found].astype(np.float64))})

    return mask.select("case_id", *AXES).groupBy("case_id").applyInArrow(run, f"case_id {kind}, z int, y int, x int, value double")
