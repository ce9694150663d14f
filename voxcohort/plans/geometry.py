"""Queries on volumes: flips, boxes, grids, resampling, profiles and what is decided from them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import estimators as S
from ..operators import registration as R
from ..operators import volumes as V
from .registry import query, rounded
from .voxels import VOX, cases, voxels

SIZE = {"z": 10, "y": 10, "x": 10}
SPACING = {"z": 2.5, "y": 1.0, "x": 1.0}


def intensities(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).select("case_id", "z", "y", "x", "value")


@query(f"WITH {VOX} SELECT case_id, 9 - z AS z, y, x, value FROM vox")
def axis_flip(spark: SparkSession, d: str) -> DataFrame:
    return V.flip(intensities(spark, d), 10)


def grids(spark: SparkSession, d: str) -> DataFrame:
    """Headers of the volumes, in x, y, z order."""
    triple = lambda *v: F.array(*[F.lit(x) for x in v])
    return cases(spark, d).select("case_id", triple(10, 10, 10).alias("size"), triple(1.0, 1.0, 2.5).alias("spacing_mm"), triple(0.0, 0.0, 0.0).alias("origin_mm"))


@query(f"WITH {VOX} SELECT case_id, CASE WHEN case_id % 3 <> 2 AND case_id % 2 = 0 THEN 9 - z ELSE z END AS z, y, x, value, CASE WHEN case_id % 3 <> 2 THEN 1.0 + case_id % 5 / 4.0 ELSE 2.5 END::DOUBLE AS spacing_z FROM vox")
def apply_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Estimated spacings and slice orders; a third of the cases has none, and stays."""
    estimated = cases(spark, d).where("case_id % 3 <> 2").select("case_id", F.array(F.lit(1.0), F.lit(1.0), 1.0 + F.col("case_id") % 5 / 4.0).alias("spacing_mm"), (F.col("case_id") % 2 == 0).alias("k_axis_flip"))
    volume, headers = V.apply_geometry(intensities(spark, d), grids(spark, d), estimated)
    return volume.join(headers.select("case_id", F.get("spacing_mm", F.lit(2)).alias("spacing_z")), "case_id").select("case_id", "z", "y", "x", "value", "spacing_z")


@query(f"""WITH {VOX}, t AS (SELECT case_id, a.i::INT AS z, b.i::INT AS y, c.i::INT AS x FROM cs, range(13) a(i), range(10) b(i), range(8) c(i) WHERE case_id % 2 = 1)
SELECT case_id, z, y, x FROM vox WHERE gt AND case_id % 2 = 0 UNION ALL SELECT t.case_id, t.z, t.y, t.x FROM t JOIN vox v ON v.case_id = t.case_id AND gt AND v.z = floor((0.5 + t.z * 2.0::DOUBLE) / 2.5 + 0.5) AND v.y = t.y AND v.x = floor(0.25 + t.x * 1.25::DOUBLE + 0.5)""")  # fmt: skip
def align_mask(spark: SparkSession, d: str) -> DataFrame:
    """Masks on the grid of their image: the same for even cases, a coarser one that starts elsewhere for the others."""
    own, odd = grids(spark, d), F.col("case_id") % 2 == 1
    triple = lambda *v: F.array(*[F.lit(x) for x in v])
    reference = own.select("case_id", F.when(odd, triple(8, 10, 13)).otherwise(F.col("size")).alias("size"), F.when(odd, triple(1.25, 1.0, 2.0)).otherwise(F.col("spacing_mm")).alias("spacing_mm"), F.when(odd, triple(0.25, 0.0, 0.5)).otherwise(F.col("origin_mm")).alias("origin_mm"))
    return V.align(voxels(spark, d).where("gt"), own, reference)


@query(f"WITH {VOX} SELECT case_id, z - 2 AS z, y - 1 AS y, x - 3 AS x, value FROM vox WHERE z BETWEEN 2 AND 7 AND y BETWEEN 1 AND 8 AND x BETWEEN 3 AND 9")
def crop_box(spark: SparkSession, d: str) -> DataFrame:
    return V.crop(intensities(spark, d), {"z": 2, "y": 1, "x": 3}, {"z": 7, "y": 8, "x": 9})


_BOX = f"{VOX}, box AS (SELECT case_id, greatest(0, min(z) - 2)::INT AS z0, least(9, max(z) + 2)::INT AS z1, greatest(0, min(y) - 3)::INT AS y0, least(9, max(y) + 3)::INT AS y1, greatest(0, min(x) - 3)::INT AS x0, least(9, max(x) + 3)::INT AS x1 FROM vox WHERE gt AND p255 >= 150 GROUP BY 1)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return V.bounding_box(voxels(spark, d).where("gt and p255 >= 150"), SIZE, SPACING, 3.0)


@query(f"WITH {_BOX} SELECT * FROM box")
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d)


@query(f"WITH {_BOX} SELECT case_id, (floor((z1 - z0) * 2.5::DOUBLE / 1.0 + 1e-6) + 1)::INT AS nz, (floor((y1 - y0) * 1.0::DOUBLE + 1e-6) + 1)::INT AS ny, (floor((x1 - x0) * 1.0::DOUBLE + 1e-6) + 1)::INT AS nx, z0 * 2.5::DOUBLE AS oz FROM box")
def target_grid(spark: SparkSession, d: str) -> DataFrame:
    sizes = [V.grid_size(F.col(f"{a}0"), F.col(f"{a}1"), SPACING[a], 1.0).alias(f"n{a}") for a in V.AXES]
    return boxes(spark, d).select("case_id", *sizes, (F.col("z0") * 2.5).alias("oz"))


@query(f"WITH {VOX}, t AS (SELECT case_id, a.i::INT AS z, b.i::INT AS y, c.i::INT AS x FROM cs, range(13) a(i), range(10) b(i), range(10) c(i)) SELECT t.case_id, t.z, t.y, t.x, coalesce(v.value, -1000) AS value FROM t LEFT JOIN vox v ON v.case_id = t.case_id AND v.z = floor(t.z * 0.8::DOUBLE + 0.5) AND v.y = t.y AND v.x = t.x")
def resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    return V.resample_nearest(intensities(spark, d), cases(spark, d), {"z": 13, "y": 10, "x": 10}, {"z": 0.8, "y": 1.0, "x": 1.0}, -1000.0)


@query(f"""WITH {VOX}, t AS (SELECT case_id, a.i::INT AS z, b.i::INT AS y, c.i::INT AS x FROM cs, range(14) a(i), range(13) b(i), range(13) c(i)),
k AS (SELECT t.*, (floor(z * 0.75) + dz.i)::INT AS sz, (floor(y * 0.75) + dy.i)::INT AS sy, (floor(x * 0.75) + dx.i)::INT AS sx,
  (CASE WHEN dz.i = 1 THEN z * 3 % 4 ELSE 4 - z * 3 % 4 END) * (CASE WHEN dy.i = 1 THEN y * 3 % 4 ELSE 4 - y * 3 % 4 END) * (CASE WHEN dx.i = 1 THEN x * 3 % 4 ELSE 4 - x * 3 % 4 END) AS w FROM t, range(2) dz(i), range(2) dy(i), range(2) dx(i)),
b AS (SELECT k.case_id, k.z, k.y, k.x, sum(w * round(v.value * 100)::BIGINT)::BIGINT AS s, count(*) FILTER (WHERE v.value IS NULL) AS missing FROM k LEFT JOIN vox v ON v.case_id = k.case_id AND v.z = sz AND v.y = sy AND v.x = sx WHERE w > 0 GROUP BY 1, 2, 3, 4)
SELECT case_id, z, y, x, CASE WHEN missing = 0 THEN s ELSE -1000 * 6400 END::BIGINT AS value_x6400 FROM b""")  # fmt: skip
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    out = V.resample_linear(intensities(spark, d), cases(spark, d), {"z": 14, "y": 13, "x": 13}, {"z": 0.75, "y": 0.75, "x": 0.75}, -1000.0)
    return out.select("case_id", "z", "y", "x", F.rint(F.col("value") * 6400).cast("bigint").alias("value_x6400"))


@query(f"WITH {_BOX} SELECT case_id, floor(z * 2.5::DOUBLE / 4)::INT AS cz, y // 4 AS cy, x // 4 AS cx, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM vox JOIN box USING (case_id) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY 1, 2, 3, 4")
def roi_downsample(spark: SparkSession, d: str) -> DataFrame:
    rows = intensities(spark, d).join(boxes(spark, d), "case_id").where("z between z0 and z1 and y between y0 and y1 and x between x0 and x1")
    cell = lambda a: F.floor(F.col(a) * SPACING[a] / 4.0).cast("int").alias(f"c{a}")
    return rows.groupBy("case_id", cell("z"), cell("y"), cell("x")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query(f"WITH {VOX}, s AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i) WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 4) SELECT DISTINCT case_id, (z + dz)::INT AS z, (y + dy)::INT AS y, (x + dx)::INT AS x FROM vox, s WHERE gt AND z + dz BETWEEN 0 AND 9 AND y + dy BETWEEN 0 AND 9 AND x + dx BETWEEN 0 AND 9")
def dilate_mask(spark: SparkSession, d: str) -> DataFrame:
    return V.dilate(voxels(spark, d).where("gt"), 2, SIZE)


@query(f"WITH {VOX}, c AS (SELECT v, case_id, z, floor(value)::BIGINT AS c0, CASE WHEN case_id % 2 = 0 THEN floor(value)::BIGINT ELSE user_id END AS c1 FROM vox), w AS (SELECT *, bool_and(c0 = c1) OVER (PARTITION BY case_id) AS same FROM c) SELECT v AS voxel_id, CASE WHEN same THEN c0::DOUBLE ELSE (c0 + c1) / 2.0::DOUBLE END AS value FROM w")
def channel_mean(spark: SparkSession, d: str) -> DataFrame:
    """Channels that agree over a whole volume collapse to the first, others are averaged."""
    v = voxels(spark, d).select("voxel_id", "case_id", F.floor("value").alias("c0"), F.when(F.col("case_id") % 2 == 0, F.floor("value")).otherwise(F.col("user_id")).alias("c1"))
    same = v.groupBy("case_id").agg(F.bool_and(F.col("c0") == F.col("c1")).alias("same"))
    return v.join(same, "case_id").select("voxel_id", F.when(F.col("same"), F.col("c0").cast("double")).otherwise((F.col("c0") + F.col("c1")) / 2.0).alias("value"))


@query(f"WITH {VOX} SELECT case_id, z, count(*) AS n FROM vox WHERE gt GROUP BY 1, 2")
def slice_profile(spark: SparkSession, d: str) -> DataFrame:
    return V.slice_profile(voxels(spark, d).where("gt"))


@query(f"WITH {VOX}, p AS (SELECT case_id, z, count(*) FILTER (WHERE gt) AS n FROM vox GROUP BY 1, 2), e AS (SELECT case_id, min(z) AS z0, max(z) AS z1 FROM p WHERE n > 0 GROUP BY 1) SELECT case_id, z - z0 AS k, n FROM p JOIN e USING (case_id) WHERE z BETWEEN z0 AND z1")
def trim_profile(spark: SparkSession, d: str) -> DataFrame:
    """Counts by slice, from the first slice that has any to the last."""
    counts = F.array(*[F.count_if(F.col("gt") & (F.col("z") == z)).cast("double") for z in range(SIZE["z"])])
    p = voxels(spark, d).groupBy("case_id").agg(S.trimmed(counts).alias("profile"))
    return p.select("case_id", F.posexplode("profile").alias("k", "n")).withColumn("n", F.col("n").cast("bigint"))


@query(f"WITH {VOX} SELECT case_id, event_type AS level, round(sum(z * 2.5::DOUBLE) / count(*), 6) AS centroid_z_mm, min(z) * 2.5::DOUBLE AS z0_mm, max(z) * 2.5::DOUBLE AS z1_mm, min(z) = 0 OR max(z) = 9 AS touches_volume_edge FROM vox WHERE value >= 120 GROUP BY 1, 2")
def centroid_extent(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("z") * 2.5
    out = voxels(spark, d).where("value >= 120").groupBy("case_id", F.col("event_type").alias("level")).agg((F.sum(z) / F.count("*")).alias("centroid_z_mm"), F.min(z).alias("z0_mm"), F.max(z).alias("z1_mm"), ((F.min("z") == 0) | (F.max("z") == 9)).alias("touches_volume_edge"))
    return rounded(out)


@query(f"WITH {VOX}, o AS (SELECT unnest(['error', 'view', 'spleen']) AS organ) SELECT cs.case_id, organ, count(v) AS voxels, count(v) * 60.0::DOUBLE / 1000 AS volume_ml, coalesce((max(z) - min(z) + 1) * 2.5::DOUBLE, 0) AS z_extent_mm FROM cs CROSS JOIN o LEFT JOIN vox ON vox.case_id = cs.case_id AND event_type = organ AND value >= 100 GROUP BY 1, 2")
def organ_extents(spark: SparkSession, d: str) -> DataFrame:
    wanted = cases(spark, d).select("case_id", F.explode(F.array(*map(F.lit, ("error", "view", "spleen")))).alias("organ"))
    found = voxels(spark, d).where("value >= 100").groupBy("case_id", F.col("event_type").alias("organ")).agg(F.count("*").alias("n"), ((F.max("z") - F.min("z") + 1) * 2.5).alias("e"))
    n = F.coalesce("n", F.lit(0))
    return wanted.join(found, ["case_id", "organ"], "left").select("case_id", "organ", n.alias("voxels"), (n * 60.0 / 1000).alias("volume_ml"), F.coalesce("e", F.lit(0.0)).alias("z_extent_mm"))


@query(f"""WITH {VOX}, f AS (SELECT case_id, min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 4 END) FILTER (WHERE value >= 250) AS k, count(*) FILTER (WHERE gt AND value >= 200) AS liver, count(*) FILTER (WHERE pred AND value >= 150) AS tumour FROM vox GROUP BY 1)
SELECT case_id, ['purchase', 'error', 'view', 'click'][k] AS reference, CASE WHEN liver > 0 THEN 'liver_and_tumour' WHEN tumour > 0 THEN 'tumour' ELSE 'full_volume' END AS crop_basis FROM f""")  # fmt: skip
def fallback_choice(spark: SparkSession, d: str) -> DataFrame:
    """The first phase of a vocabulary that has foreground, and the first mask that can carry a crop."""
    vocabulary = F.array(*map(F.lit, ("purchase", "error", "view", "click")))
    place = F.nullif(F.array_position(vocabulary, F.col("event_type")), F.lit(0))
    f = voxels(spark, d).groupBy("case_id").agg(F.min(F.when(F.col("value") >= 250, place)).alias("k"), F.count_if(F.expr("gt and value >= 200")).alias("liver"), F.count_if(F.expr("pred and value >= 150")).alias("tumour"))
    return f.select("case_id", F.try_element_at(vocabulary, F.col("k").cast("int")).alias("reference"), F.when(F.col("liver") > 0, "liver_and_tumour").when(F.col("tumour") > 0, "tumour").otherwise("full_volume").alias("crop_basis"))


def _blur(source: str, axis: str, sigma: float) -> str:
    reach, own = math.ceil(4 * sigma), [f"h.{a} = " + (f"least(9, greatest(0, g.{a} + j))" if a == axis else f"g.{a}") for a in "zyx"]
    weights = f"(SELECT j, w / sum(w) OVER () AS w FROM (SELECT j, exp(-0.5::DOUBLE * pow(j / {sigma}::DOUBLE, 2)) AS w FROM range({-reach}, {reach + 1}) t(j)))"
    return f"SELECT g.case_id, g.z, g.y, g.x, sum(w * h.v) AS v FROM {source} g, {weights} k JOIN {source} h ON h.case_id = g.case_id AND {' AND '.join(own)} GROUP BY 1, 2, 3, 4"


@query(f"""WITH {VOX}, g0 AS (SELECT cs.case_id, a.i::INT AS z, b.i::INT AS y, c.i::INT AS x, coalesce(gt, false)::INT::DOUBLE AS v FROM cs, range(10) a(i), range(10) b(i), range(10) c(i) LEFT JOIN vox ON vox.case_id = cs.case_id AND vox.z = a.i AND vox.y = b.i AND vox.x = c.i),
g1 AS ({_blur("g0", "z", 1.6)}), g2 AS ({_blur("g1", "y", 4.0)}), g3 AS ({_blur("g2", "x", 4.0)}) SELECT case_id, z, y, x, round(v, 6) AS value FROM g3 WHERE v > 1e-6""")  # fmt: skip
def smooth_mask(spark: SparkSession, d: str) -> DataFrame:
    """Masks after a Gaussian of 4 mm."""
    return rounded(R.smoothed(voxels(spark, d).where("gt"), 4.0, SPACING, SIZE, np.float64))
