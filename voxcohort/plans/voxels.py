"""The voxel view over `events`, and its SQL: a 10 x 10 x 10 grid for each thousand events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .registry import read

#: mm3 of a voxel; thresholds (of 255) of the probability sweep.
VOLUME = 60.0
LEVELS = tuple(E.level_of(p) for p in E.THRESHOLDS)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    div = lambda a, n: F.floor(a / n).cast("bigint")
    marked = F.col("event_type").isin("error", "view")
    return e.select(
        i.alias("voxel_id"), div(i, 1000).alias("case_id"), div(i % 1000, 100).cast("int").alias("z"), div(i % 100, 10).cast("int").alias("y"), (i % 10).cast("int").alias("x"),
        ((F.col("event_type") == "error") & (F.col("value") >= 40)).alias("gt"), (marked & (F.col("value") >= 60)).alias("pred"),
        F.when(marked, F.least(F.floor("value"), F.lit(255))).otherwise(0).cast("int").alias("p255"), F.concat(F.lit("D"), (div(i, 1000) % 3).cast("string")).alias("dataset"),
        "event_type", "value", "user_id",
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header table: a row for each volume. Volumes are numbered without gaps, so the ends of the ids' one column tell
    them all, without a distinct over voxels."""
    ids = read(spark, sf_dir, "events").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).where("a is not null")
    case = F.explode(F.sequence(F.floor(F.col("a") / 1000).cast("bigint"), F.floor(F.col("b") / 1000).cast("bigint")))
    return ids.select(case.alias("case_id")).withColumn("dataset", F.concat(F.lit("D"), (F.col("case_id") % 3).cast("string")))


#: Cases without a voxel in either mask, one for each dataset, as all volumes have some; by construction, not by a cut.
EMPTY = ((-1, "D0"), (-2, "D1"), (-3, "D2"))


def with_empty(found: DataFrame) -> DataFrame:
    return found.unionByName(found.sparkSession.createDataFrame(list(EMPTY), "case_id long, dataset string"))


VOX = """vox AS (SELECT event_id AS v, event_id // 1000 AS case_id, ((event_id % 1000) // 100)::INT AS z, ((event_id % 100) // 10)::INT AS y, (event_id % 10)::INT AS x,
  event_type = 'error' AND value >= 40 AS gt, event_type IN ('error', 'view') AND value >= 60 AS pred,
  (CASE WHEN event_type IN ('error', 'view') THEN least(floor(value), 255) ELSE 0 END)::INT AS p255, 'D' || ((event_id // 1000) % 3) AS dataset, event_type, value, user_id FROM events),
cs AS (SELECT DISTINCT case_id, dataset FROM vox)"""


def components(name: str, source: str) -> str:
    """CTEs that end in `name` (k, case_id, z, y, x, v, component) of `source`, a select of (k, case_id, z, y, x, v)."""
    return f"""{name}_m AS MATERIALIZED ({source}),
{name}_e AS MATERIALIZED (SELECT a.k, a.v AS a, b.v AS b FROM {name}_m a JOIN {name}_m b ON a.k = b.k AND a.case_id = b.case_id
  AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.v <> b.v),
{name}_r(k, v, r) AS (SELECT k, v, v FROM {name}_m UNION SELECT q.k, q.v, e.b FROM {name}_r q JOIN {name}_e e ON e.k = q.k AND e.a = q.r),
{name} AS MATERIALIZED (SELECT m.*, c.component FROM {name}_m m JOIN (SELECT k, v, min(r) AS component FROM {name}_r GROUP BY k, v) c ON c.k = m.k AND c.v = m.v)"""


def mask(where: str) -> str:
    return f"SELECT 0 AS k, case_id, z, y, x, v FROM vox WHERE {where}"


def sweep(levels: tuple[int, ...]) -> str:
    return f"SELECT t.k, case_id, z, y, x, v FROM vox, (SELECT unnest({list(levels)}) AS k) t WHERE p255 >= t.k"


SWEEP = sweep(LEVELS)
#: All cases, the empty ones included.
ALL_CASES = "ac AS (SELECT case_id, dataset FROM cs UNION ALL SELECT * FROM (VALUES (-1, 'D0'), (-2, 'D1'), (-3, 'D2')))"


def bin_of(d: str) -> str:
    return f"CASE WHEN {d} <= 5 THEN '0_5mm' WHEN {d} <= 10 THEN '5_10mm' WHEN {d} <= 15 THEN '10_15mm' ELSE 'gt_15mm' END"


def esd_of(n: str) -> str:
    return f"pow({n} * 60.0::DOUBLE * (6.0::DOUBLE / pi()), 1.0::DOUBLE / 3)"


def evaluation(found: str = mask("pred"), filtered: str = "") -> str:
    """CTEs: g, p (components), gs, ps (sizes), les (lesions by setting), fp, tot (case totals)."""
    return f"""WITH RECURSIVE {VOX}, {components("g", mask("gt"))}, {components("p", found)}{filtered},
ks AS (SELECT DISTINCT k FROM p),
gs AS (SELECT *, {bin_of("esd_mm")} AS size_bin FROM (SELECT case_id, component AS lesion, count(*) AS voxels, {esd_of("count(*)")} AS esd_mm FROM g GROUP BY 1, 2)),
ps AS (SELECT *, {bin_of("esd_mm")} AS size_bin FROM (SELECT k, case_id, component AS piece, count(*) AS voxels, {esd_of("count(*)")} AS esd_mm FROM p GROUP BY 1, 2, 3)),
ov AS (SELECT p.k, g.component AS lesion, p.component AS piece, count(*) AS shared FROM g JOIN p ON g.v = p.v GROUP BY 1, 2, 3),
cov AS (SELECT ov.k, ov.lesion, sum(shared)::BIGINT AS covered, sum(ps.voxels)::BIGINT AS touching FROM ov JOIN ps ON ps.k = ov.k AND ps.piece = ov.piece GROUP BY 1, 2),
les AS (SELECT ks.k, gs.*, cs.dataset, coalesce(covered, 0) AS covered, coalesce(covered, 0)::DOUBLE / voxels AS covered_fraction,
  coalesce(covered, 0) >= greatest(1, 0.1 * voxels) AS detected, 2.0 * coalesce(covered, 0) / (voxels + coalesce(touching, 0)) AS lesion_dice
  FROM gs JOIN cs USING (case_id) CROSS JOIN ks LEFT JOIN cov ON cov.k = ks.k AND cov.lesion = gs.lesion),
fp AS (SELECT ps.*, cs.dataset FROM ps JOIN cs USING (case_id) WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.k = ps.k AND ov.piece = ps.piece)),
tot AS (SELECT case_id, dataset, count(*) FILTER (WHERE gt) AS gt_voxels, count(*) FILTER (WHERE pred) AS pred_voxels, count(*) FILTER (WHERE gt AND pred) AS tp_voxels,
  2.0 * count(*) FILTER (WHERE gt AND pred) / nullif(count(*) FILTER (WHERE gt) + count(*) FILTER (WHERE pred), 0) AS case_dice FROM vox GROUP BY 1, 2)"""


def wilson_of(k: str, n: str) -> tuple[str, str]:
    p, m = f"({k})::DOUBLE / nullif({n}, 0)", f"nullif({n}, 0)::DOUBLE"
    centre, half = f"({p} + 1.96 * 1.96 / (2 * {m}))", f"1.96 * sqrt({p} * (1 - {p}) / {m} + 1.96 * 1.96 / (4 * {m} * {m}))"
    scale = f"(1 + 1.96 * 1.96 / {m})"
    return f"({centre} / {scale} - {half} / {scale})", f"({centre} / {scale} + {half} / {scale})"
