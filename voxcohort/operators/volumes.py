"""Volumes as voxel relations (case_id, z, y, x, value): flips, boxes, grids, resampling, morphology.

All of these are projections, aggregates and equi-joins on computed indices, so they pipeline with scans and shuffle on
(case_id, z, y, x) at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def flip(volume: DataFrame, size: int, axis: str = "z") -> DataFrame:
    return volume.withColumn(axis, F.lit(size - 1) - F.col(axis))


def crop(volume: DataFrame, low: dict[str, int], high: dict[str, int]) -> DataFrame:
    """Voxels within the box, both ends included, on the box's own indices."""
    for a in AXES:
        volume = volume.where(F.col(a).between(low[a], high[a])).withColumn(a, F.col(a) - low[a])
    return volume


def bounding_box(mask: DataFrame, size: dict[str, int], spacing: dict[str, float], margin: float) -> DataFrame:
    """For each case the box of its foreground, padded by `margin` mm and clamped to the grid."""
    pad = {a: F.ceil(F.lit(margin / spacing[a])).cast("int") for a in AXES}
    ends = [f(a) for a in AXES for f in (lambda a: F.greatest(F.lit(0), F.min(a) - pad[a]).alias(f"{a}0"), lambda a: F.least(F.lit(size[a] - 1), F.max(a) + pad[a]).alias(f"{a}1"))]
    return mask.groupBy("case_id").agg(*ends)


def grid_size(low: Column, high: Column, spacing: float, target: float) -> Column:
    return (F.floor((high - low) * F.lit(spacing) / F.lit(target) + F.lit(1e-6)) + 1).cast("int")


def points(cases: DataFrame, counts: dict[str, int]) -> DataFrame:
    """A target grid of the given size for each case."""
    for a in AXES:
        cases = cases.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(counts[a] - 1))))
    return cases


def resample_nearest(volume: DataFrame, cases: DataFrame, counts: dict[str, int], steps: dict[str, float], fill: float) -> DataFrame:
    """Each target point takes the voxel nearest to index * step, or `fill` outside the grid."""
    target = points(cases.select("case_id"), counts)
    for a in AXES:
        target = target.withColumn(f"s{a}", F.floor(F.col(a) * F.lit(float(steps[a])) + 0.5).cast("int"))
    source = volume.select("case_id", *[F.col(a).alias(f"s{a}") for a in AXES], "value")
    return target.join(source, ["case_id", "sz", "sy", "sx"], "left").select("case_id", *AXES, F.coalesce("value", F.lit(fill)).alias("value"))


def resample_linear(volume: DataFrame, cases: DataFrame, counts: dict[str, int], steps: dict[str, float], fill: float) -> DataFrame:
    """Trilinear blend of the eight corners around index * step, in one interpolation; `fill` outside the grid.

    A voxel says which points it is a corner of, so its share is added up where it is read and no corner is looked up. The
    points of `cases` join those sums; they are made in as many tasks as a shuffle has, as a list of cases may lie in one.
    Each corner is a bit, so a point that lacks one shows, whatever rows a voxel has.
    """
    shares, weight, corner, wanted = volume.select("case_id", *[F.col(a).alias(f"s{a}") for a in AXES], "value"), F.lit(1.0), F.lit(1), F.lit(1)
    for n, a in enumerate(AXES):
        s, step, last = F.col(f"s{a}"), F.lit(float(steps[a])), F.lit(counts[a] - 1)
        low, high = F.greatest(F.lit(0), F.floor((s - 1) / step).cast("int") - 1), F.least(last, F.ceil((s + 1) / step).cast("int") + 1)
        span = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        at = F.col(a) * step
        part, upper = at - F.floor(at), s - F.floor(at)
        shares = shares.withColumn(a, F.explode(span)).where((upper == 0) | (upper == 1) & (part > 0))
        weight = weight * F.when(upper == 1, part).otherwise(1 - part)
        corner = corner * F.when(upper == 1, 1 << (1 << n)).otherwise(1)
        wanted = wanted * F.when(part > 0, 1 + (1 << (1 << n))).otherwise(1)
    blend, met = F.sum(weight * F.col("value")).alias("blend"), F.bit_or(corner).alias("met")
    found = shares.groupBy("case_id", *AXES).agg(blend, met, F.bool_or(F.col("value").isNull()).alias("empty"))
    tasks = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    target = points(cases.select("case_id").repartition(tasks, "case_id"), counts)
    whole = ~F.col("empty") & (F.col("met") == wanted)
    return target.join(found, ["case_id", *AXES], "left").select("case_id", *AXES, F.when(whole, F.col("blend")).otherwise(F.lit(fill)).alias("value"))


def dilate(mask: DataFrame, radius: int, size: dict[str, int]) -> DataFrame:
    """Foreground within `radius` voxels of foreground, on the same grid."""
    span = range(-radius, radius + 1)
    ball = [(a, b, c) for a in span for b in span for c in span if a * a + b * b + c * c <= radius * radius]
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{n}") for n, v in zip(AXES, o, strict=True)]) for o in ball])).alias("s")
    moved = mask.select("case_id", *AXES, steps).select("case_id", *[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in AXES])
    inside = [F.col(a).between(0, size[a] - 1) for a in AXES]
    return moved.where(inside[0] & inside[1] & inside[2]).distinct()


def slice_profile(mask: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    return mask.groupBy(*keys, "z").agg(F.count("*").alias("n"))


def apply_geometry(volume: DataFrame, headers: DataFrame, geometry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(volume, headers) with estimated spacings in place of those of the headers, and slices reversed on the same grid
    where the geometry says so. Cases without a row in `geometry` (case_id, spacing_mm, k_axis_flip) stay as they are.
    Headers have size and spacing_mm in x, y, z order."""
    known = headers.join(geometry.select("case_id", F.col("spacing_mm").alias("estimated"), "k_axis_flip"), "case_id", "left")
    overwritten = known.withColumn("spacing_mm", F.coalesce("estimated", "spacing_mm")).drop("estimated", "k_axis_flip")
    turned = known.where("k_axis_flip").select("case_id", F.get("size", F.lit(2)).alias("nz"))
    rows = volume.join(turned, "case_id", "left").withColumn("z", F.coalesce(F.col("nz") - 1 - F.col("z"), F.col("z"))).drop("nz")
    return rows, overwritten


def _place(index: Column, own: str, axis: int, other: str) -> Column:
    """Index on the grid of struct column `other` that is nearest to an index on that of `own`, along one axis."""
    mm = F.get(f"{own}.origin_mm", F.lit(axis)) + index * F.get(f"{own}.spacing_mm", F.lit(axis))
    return F.floor((mm - F.get(f"{other}.origin_mm", F.lit(axis))) / F.get(f"{other}.spacing_mm", F.lit(axis)) + 0.5).cast("int")


def align(mask: DataFrame, own: DataFrame, reference: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """The mask's foreground on the grid of `reference`, which has one row for each case as `own` (size, spacing_mm,
    origin_mm in x, y, z order). On the same grid voxels stay; else each point of the reference takes the voxel nearest
    to it, and points outside of the mask's grid are empty. Only points near foreground are made: a voxel says which
    range of points it may be nearest to.
    """
    a, b = (h.select("case_id", F.struct("size", "spacing_mm", "origin_mm").alias(n)) for h, n in ((own, "g"), (reference, "r")))
    near = lambda k: F.forall(F.zip_with(f"g.{k}", f"r.{k}", lambda p, q: F.abs(p - q) <= tolerance), lambda ok: ok)
    grids = a.join(b, "case_id").withColumn("same", (F.col("g.size") == F.col("r.size")) & near("spacing_mm") & near("origin_mm"))
    rows = mask.select("case_id", *AXES).join(grids, "case_id")
    moved = rows.where("not same")
    for axis, name in zip((2, 1, 0), AXES, strict=True):
        half = lambda s, axis=axis, name=name: _place(F.col(name) + F.lit(s), "g", axis, "r")
        last = F.get("r.size", F.lit(axis)) - 1
        span = F.sequence(F.greatest(F.lit(0), half(-0.5) - 1), F.least(last, half(0.5) + 1))
        some = (half(0.5) + 1 >= 0) & (half(-0.5) - 1 <= last)
        moved = moved.withColumn(f"p{name}", F.explode(F.when(some, span).otherwise(F.array().cast("array<int>")))).where(_place(F.col(f"p{name}"), "r", axis, "g") == F.col(name))
    return rows.where("same").select("case_id", *AXES).unionByName(moved.select("case_id", *[F.col(f"p{n}").alias(n) for n in AXES]))


def fallback_mask(segmentation: DataFrame, own: DataFrame, stored: DataFrame, label: int, flipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mask, profile): a segmentation's label on the grid that a volume is stored with, slices turned back where
    `flipped` (case_id, flip) says that it was segmented in reversed order; and slices, first and last of each case."""
    mask = align(segmentation.where(F.col("value") == label), own, stored)
    turned = stored.join(flipped.where("flip"), "case_id").select("case_id", F.get("size", F.lit(2)).alias("nz"))
    back = mask.join(turned, "case_id", "left").withColumn("z", F.coalesce(F.col("nz") - 1 - F.col("z"), F.col("z"))).drop("nz")
    profile = back.groupBy("case_id").agg(F.count_distinct("z").alias("slices"), F.min("z").alias("first"), F.max("z").alias("last"), (F.max("z") - F.min("z") + 1).alias("z_extent"))
    return back, profile
