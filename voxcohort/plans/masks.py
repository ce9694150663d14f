"""Queries on masks: components, lesions, detection metrics, the probability sweep, and what manifests need of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SIZE_BINS, diameter, ratio, size_bin, wilson
from ..operators import evaluation as E
from ..operators import splits
from ..operators.components import contingency, drop_small, label_components, numbered
from .registry import query, read, rounded
from .voxels import ALL_CASES, LEVELS, SWEEP, VOLUME, VOX, bin_of, cases, components, esd_of, evaluation, mask, voxels, wilson_of, with_empty

KEYS = ("case_id",)


def dataset_of():
    return F.concat(F.lit("D"), (F.col("case_id") % 3).cast("string"))


def labelled(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return label_components(voxels(spark, d).where(kind))


def evaluated(spark: SparkSession, d: str, least: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cases, lesion rows, false positives and case totals, all from one table of shared voxels."""
    table, every = contingency(voxels(spark, d), least=least), cases(spark, d)
    rows, fps = (f(table, VOLUME).drop("threshold").withColumn("dataset", dataset_of()) for f in (E.lesions_of, E.false_positives_of))
    return every, rows, fps, E.case_totals_of(table, every)


def swept(spark: SparkSession, d: str, levels: tuple[int, ...] = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cases, lesion rows, false positives and thresholds of the sweep."""
    table = contingency(voxels(spark, d), "p255", levels)
    rows, fps = (f(table, VOLUME).withColumn("dataset", dataset_of()) for f in (E.lesions_of, E.false_positives_of))
    return cases(spark, d), rows, fps, spark.createDataFrame([(t,) for t in levels], "threshold int")


@query(f"WITH RECURSIVE {VOX}, {components('g', mask('gt'))} SELECT case_id, v AS voxel_id, component FROM g")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d, "gt").select("case_id", "voxel_id", "component")


@query(f"WITH RECURSIVE {VOX}, {components('g', mask('gt'))} SELECT case_id, component, count(*) AS voxels FROM g GROUP BY 1, 2")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d, "gt").groupBy("case_id", "component").agg(F.count("*").alias("voxels"))


@query(f"""WITH RECURSIVE {VOX}, {components('g', mask('gt'))}, s AS (SELECT case_id, component, count(*) AS voxels FROM g GROUP BY 1, 2)
SELECT case_id, component, row_number() OVER (PARTITION BY case_id ORDER BY component)::INT AS lesion_component_id, voxels AS voxel_count, voxels * 60.0::DOUBLE AS volume_mm3,
  voxels * 60.0::DOUBLE / 1000 AS volume_ml, round({esd_of('voxels')}, 6) AS equivalent_spherical_diameter_mm, {bin_of(esd_of('voxels'))} AS size_bin FROM s""")  # fmt: skip
def lesion_table(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = labelled(spark, d, "gt").groupBy("case_id", "component").agg(F.count("*").alias("voxel_count"))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("component")).alias("lesion_component_id")
    volume = F.col("voxel_count") * VOLUME
    return rounded(s.select("case_id", "component", number, "voxel_count", volume.alias("volume_mm3"), (volume / 1000).alias("volume_ml"), diameter(volume).alias("equivalent_spherical_diameter_mm"), size_bin(diameter(volume)).alias("size_bin")))


@query(f"SELECT event_id, round(pow((event_id % 5000 + 1) * (6.0::DOUBLE / pi()), 1.0::DOUBLE / 3), 6) AS esd_mm FROM events")
def equivalent_diameter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(read(spark, d, "events").select("event_id", diameter((F.col("event_id") % 5000 + 1).cast("double")).alias("esd_mm")))


@query(f"SELECT {bin_of('value')} AS size_bin, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def size_binning(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(size_bin(F.col("value")).alias("size_bin")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"WITH RECURSIVE {VOX}, {components('g', mask('gt'))}, {components('p', mask('pred'))} SELECT g.case_id, g.component AS lesion, p.component AS piece, count(*) AS shared FROM g JOIN p ON g.v = p.v GROUP BY 1, 2, 3")
def component_overlap(spark: SparkSession, d: str) -> DataFrame:
    return E.overlap(labelled(spark, d, "gt"), labelled(spark, d, "pred"), KEYS, KEYS)


@query(evaluation() + " SELECT case_id, lesion, voxels, round(esd_mm, 6) AS esd_mm, size_bin, covered, round(covered_fraction, 6) AS covered_fraction, detected, round(lesion_dice, 6) AS lesion_dice FROM les")
def case_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluated(spark, d)[1].drop("dataset"))


_LOW, _HIGH = wilson_of("detected", "lesions")
_BINNED = """,
bins AS (SELECT unnest(['0_5mm', '5_10mm', '10_15mm', 'gt_15mm']) AS size_bin),
sc AS (SELECT coalesce(dataset, 'overall') AS scope, count(*) AS cases FROM cs GROUP BY GROUPING SETS ((), (dataset))),
lb AS (SELECT coalesce(dataset, 'overall') AS scope, size_bin, count(*) AS lesions, count(*) FILTER (WHERE detected) AS detected, sum(voxels) AS gt, sum(covered) AS cov, avg(lesion_dice) AS dice FROM les GROUP BY GROUPING SETS ((size_bin), (dataset, size_bin))),
fb AS (SELECT coalesce(dataset, 'overall') AS scope, size_bin, count(*) AS n FROM fp GROUP BY GROUPING SETS ((size_bin), (dataset, size_bin))),
bm AS (SELECT scope, size_bin, cases, coalesce(lesions, 0) AS lesions, coalesce(detected, 0) AS detected, coalesce(n, 0) AS fps, gt, cov, dice FROM sc CROSS JOIN bins LEFT JOIN lb USING (scope, size_bin) LEFT JOIN fb USING (scope, size_bin))
"""


@query(evaluation() + _BINNED + f"""SELECT scope, size_bin, cases, lesions, detected, round(detected::DOUBLE / nullif(lesions, 0), 6) AS sensitivity, round({_LOW}, 6) + 0.0 AS ci95_low, round({_HIGH}, 6) AS ci95_high,
round(detected::DOUBLE / nullif(detected + fps, 0), 6) AS lesion_precision, round(cov::DOUBLE / gt, 6) AS voxel_recall, round(dice, 6) AS lesion_dice_mean, fps AS false_positive_components FROM bm""")  # fmt: skip
def binned_detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    every, rows, fps, _ = evaluated(spark, d)
    return rounded(E.detection_metrics(every, rows, fps))


_OVERALL = """,
sc AS (SELECT coalesce(dataset, 'overall') AS scope, count(*) AS cases FROM cs GROUP BY GROUPING SETS ((), (dataset))),
lo AS (SELECT coalesce(dataset, 'overall') AS scope, count(*) AS lesions, count(*) FILTER (WHERE detected) AS detected FROM les GROUP BY GROUPING SETS ((), (dataset))),
fo AS (SELECT coalesce(dataset, 'overall') AS scope, count(*) AS fps FROM fp GROUP BY GROUPING SETS ((), (dataset))),
too AS (SELECT coalesce(dataset, 'overall') AS scope, sum(tp_voxels)::BIGINT AS tp, sum(gt_voxels)::BIGINT AS gt, sum(pred_voxels)::BIGINT AS pred, avg(case_dice) AS dice FROM tot GROUP BY GROUPING SETS ((), (dataset))),
om AS (SELECT scope, cases, coalesce(lesions, 0) AS lesions, coalesce(detected, 0) AS detected, coalesce(fps, 0) AS fps, tp, gt, pred, dice,
  detected::DOUBLE / nullif(lesions, 0) AS recall, detected::DOUBLE / nullif(detected + coalesce(fps, 0), 0) AS prec FROM sc LEFT JOIN lo USING (scope) LEFT JOIN fo USING (scope) LEFT JOIN too USING (scope))
"""


@query(evaluation() + _OVERALL + "SELECT scope, lesions, detected, fps AS false_positive_components, round(recall, 6) AS recall, round(prec, 6) AS precision, round(CASE WHEN recall > 0 AND prec > 0 THEN 2 * recall * prec / (recall + prec) END, 6) AS f1 FROM om")
def lesion_prf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.overall_metrics(*evaluated(spark, d)).select("scope", "lesions", "detected", "false_positive_components", "recall", "precision", "f1"))


@query(evaluation() + _OVERALL + "SELECT scope, round(tp::DOUBLE / nullif(gt, 0), 6) AS voxel_recall_pooled, round(tp::DOUBLE / nullif(pred, 0), 6) AS voxel_precision_pooled, round(2.0 * tp / nullif(gt + pred, 0), 6) AS voxel_dice_pooled FROM om")
def pooled_voxel_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.overall_metrics(*evaluated(spark, d)).select("scope", "voxel_recall_pooled", "voxel_precision_pooled", "voxel_dice_pooled"))


_DICE = f"{VOX}, {ALL_CASES}, t AS (SELECT ac.case_id, ac.dataset, 2.0 * count(*) FILTER (WHERE gt AND pred) / nullif(count(*) FILTER (WHERE gt) + count(*) FILTER (WHERE pred), 0) AS dice FROM ac LEFT JOIN vox USING (case_id) GROUP BY 1, 2)"


def dice(spark: SparkSession, d: str) -> DataFrame:
    return E.case_totals_marked(with_empty(cases(spark, d)), voxels(spark, d))


@query(f"WITH {_DICE} SELECT dataset, count(*) AS cases, count(dice) AS defined, round(avg(dice), 6) AS case_tumour_dice_mean FROM t GROUP BY 1")
def macro_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the defined Dice values of whole masks; cases with two empty masks have none."""
    return rounded(dice(spark, d).groupBy("dataset").agg(F.count("*").alias("cases"), F.count("case_dice").alias("defined"), F.avg("case_dice").alias("case_tumour_dice_mean")))


@query(evaluation() + _OVERALL + "SELECT scope, cases, lesions, detected, fps AS false_positive_components, round(dice, 6) AS case_tumour_dice_mean, round(fps::DOUBLE / cases, 6) AS fp_per_case FROM om")
def scope_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.overall_metrics(*evaluated(spark, d)).select("scope", "cases", "lesions", "detected", "false_positive_components", "case_tumour_dice_mean", "fp_per_case"))


_WL, _WH = wilson_of("k", "n")


@query(f"WITH {VOX}, {ALL_CASES}, t AS (SELECT case_id, count(*) FILTER (WHERE gt AND pred) AS k, count(*) FILTER (WHERE gt) AS n FROM ac LEFT JOIN vox USING (case_id) GROUP BY 1) SELECT case_id, k, n, round({_WL}, 6) + 0.0 AS ci95_low, round({_WH}, 6) AS ci95_high FROM t")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    """Of each case's true voxels those found, with their interval; nulls where there are none."""
    low, high = wilson(F.col("k"), F.col("n"))
    t = dice(spark, d).select("case_id", F.col("tp_voxels").alias("k"), F.col("gt_voxels").alias("n"))
    return rounded(t.select("case_id", "k", "n", low.alias("ci95_low"), high.alias("ci95_high")))


@query(f"WITH {VOX} SELECT case_id, z, round(count(*) FILTER (WHERE gt AND pred)::DOUBLE / nullif(count(*) FILTER (WHERE gt), 0), 6) AS recall, round(count(*) FILTER (WHERE gt AND pred)::DOUBLE / nullif(count(*) FILTER (WHERE pred), 0), 6) AS precision FROM vox GROUP BY 1, 2")
def safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    both = F.count_if(F.expr("gt and pred"))
    return rounded(voxels(spark, d).groupBy("case_id", "z").agg(ratio(both, F.count_if("gt")).alias("recall"), ratio(both, F.count_if("pred")).alias("precision")))


@query(f"WITH RECURSIVE {VOX}, {components('p', mask('pred'))}, big AS (SELECT case_id, component, row_number() OVER (PARTITION BY case_id ORDER BY component)::INT AS label FROM p GROUP BY 1, 2 HAVING count(*) >= 3) SELECT case_id, v AS voxel_id, component, label FROM p JOIN big USING (case_id, component)")
def min_component_filter(spark: SparkSession, d: str) -> DataFrame:
    """Components of three voxels or more, numbered anew."""
    return numbered(drop_small(labelled(spark, d, "pred"), 3)).select("case_id", "voxel_id", "component", "label")


@query(f"WITH {VOX} SELECT case_id, count(*) FILTER (WHERE p255 > 0) AS foreground, count(*) FILTER (WHERE p255 = 60) AS labelled, count(*) FILTER (WHERE p255 >= 128) AS likely FROM vox GROUP BY 1")
def mask_threshold(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).groupBy("case_id").agg(F.count_if(F.col("p255") > 0).alias("foreground"), F.count_if(F.col("p255") == 60).alias("labelled"), F.count_if(F.col("p255") >= 128).alias("likely"))


@query(f"WITH {_DICE} SELECT case_id, round(dice, 6) AS evaluated_dice, round(coalesce(dice, 1.0), 6) AS registered_dice FROM t")
def mask_dice(spark: SparkSession, d: str) -> DataFrame:
    """Both conventions for two empty masks: null when evaluating, 1 when registering."""
    return rounded(dice(spark, d).select("case_id", F.col("case_dice").alias("evaluated_dice"), F.coalesce("case_dice", F.lit(1.0)).alias("registered_dice")))


@query(f"WITH {VOX} SELECT case_id, z, y, x FROM vox WHERE gt OR pred")
def mask_union(spark: SparkSession, d: str) -> DataFrame:
    """Masks are flags of one relation, so their algebra is a filter."""
    return voxels(spark, d).where("gt or pred").select("case_id", "z", "y", "x")


@query(f"WITH {VOX} SELECT case_id, z, y, x FROM vox WHERE gt AND pred")
def mask_intersection(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).where("gt and pred").select("case_id", "z", "y", "x")


@query(f"WITH {VOX} SELECT case_id, count(*) * 60.0::DOUBLE / 1000 AS volume_ml, (max(z) - min(z) + 1) * 2.5::DOUBLE AS z_extent_mm FROM vox WHERE gt GROUP BY 1")
def mask_volume_extent(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).where("gt").groupBy("case_id").agg((F.count("*") * VOLUME / 1000).alias("volume_ml"), ((F.max("z") - F.min("z") + 1) * 2.5).alias("z_extent_mm"))


_LESIONS = f"WITH RECURSIVE {VOX}, {components('g', mask('gt'))}, s AS (SELECT *, {bin_of('esd')} AS size_bin, 'D' || (case_id % 3) AS dataset FROM (SELECT case_id, component, count(*) AS voxels, {esd_of('count(*)')} AS esd FROM g GROUP BY 1, 2))"


def lesion_rows(spark: SparkSession, d: str) -> DataFrame:
    return E.sizes(labelled(spark, d, "gt"), KEYS, VOLUME).withColumn("dataset", dataset_of())


@query(_LESIONS + " SELECT dataset, size_bin, count(*) AS lesions, count(DISTINCT case_id) AS cases FROM s GROUP BY 1, 2")
def lesion_and_case_counts(spark: SparkSession, d: str) -> DataFrame:
    return lesion_rows(spark, d).groupBy("dataset", "size_bin").agg(F.count("*").alias("lesions"), F.count_distinct("case_id").alias("cases"))


@query(_LESIONS + ", b AS (SELECT unnest(['0_5mm', '5_10mm', '10_15mm', 'gt_15mm']) AS size_bin), ds AS (SELECT DISTINCT dataset FROM cs) SELECT dataset, size_bin, count(component) AS lesions, round(coalesce(100.0 * count(component) / nullif(sum(count(component)) OVER (PARTITION BY dataset), 0), 0), 6) AS percent FROM ds CROSS JOIN b LEFT JOIN s USING (dataset, size_bin) GROUP BY 1, 2")
def percent_of_total(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    grid = cases(spark, d).select("dataset").distinct().crossJoin(F.broadcast(E.bins_frame(cases(spark, d))))
    counts = lesion_rows(spark, d).groupBy("dataset", "size_bin").agg(F.count("*").alias("n"))
    out = grid.join(counts, ["dataset", "size_bin"], "left").select("dataset", "size_bin", F.coalesce("n", F.lit(0)).alias("lesions"))
    return rounded(out.withColumn("percent", F.coalesce(ratio(100 * F.col("lesions"), F.sum("lesions").over(Window.partitionBy("dataset"))), F.lit(0.0))))


@query(_LESIONS + " SELECT case_id, round(min(esd), 6) AS minimum_esd_mm, round(median(esd), 6) AS median_esd_mm, round(max(esd), 6) AS maximum_esd_mm FROM cs LEFT JOIN s USING (case_id) GROUP BY 1")
def min_median_max(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d).select("case_id").join(lesion_rows(spark, d), "case_id", "left")
    return rounded(rows.groupBy("case_id").agg(F.min("esd_mm").alias("minimum_esd_mm"), F.median("esd_mm").alias("median_esd_mm"), F.max("esd_mm").alias("maximum_esd_mm")))


def case_bins(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's lesion counts: a column for each bin, zero-filled."""
    counts = lesion_rows(spark, d).groupBy("case_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("size_bin") == b).alias(b) for b in SIZE_BINS])
    out = cases(spark, d).join(counts, "case_id", "left").fillna(0)
    return out.withColumn("diagnosis", F.element_at(F.array(*map(F.lit, DIAGNOSES)), (F.col("case_id") % len(DIAGNOSES) + 1).cast("int")))


#: Diagnoses given to cases by number, as the driver's tables have none.
DIAGNOSES = ("control", "HH", "HCC", "ICC", "cHCC-CCA", "metastasis")
_CASE_BINS = _LESIONS + """, cb AS (SELECT cs.case_id, cs.dataset, count(component) AS total, count(*) FILTER (WHERE size_bin = '0_5mm') AS b0, count(*) FILTER (WHERE size_bin = '5_10mm') AS b1,
 count(*) FILTER (WHERE size_bin = '10_15mm') AS b2, count(*) FILTER (WHERE size_bin = 'gt_15mm') AS b3, ['control', 'HH', 'HCC', 'ICC', 'cHCC-CCA', 'metastasis'][cs.case_id % 6 + 1] AS diagnosis FROM cs LEFT JOIN s USING (case_id) GROUP BY 1, 2)"""  # fmt: skip


@query(_CASE_BINS + " SELECT case_id, b0 > 0 OR b1 > 0 AS small, b2 > 0 OR b3 > 0 AS large FROM cb")
def any_bin_predicate(spark: SparkSession, d: str) -> DataFrame:
    positive = lambda bins: F.exists(F.array(*bins), lambda n: n > 0)
    return case_bins(spark, d).select("case_id", positive(SIZE_BINS[:2]).alias("small"), positive(SIZE_BINS[2:]).alias("large"))


def case_labels(rows: DataFrame) -> DataFrame:
    """Stratification labels of a case in fixed order."""
    labels = [F.concat(F.lit("dataset="), "dataset"), F.concat(F.lit("diagnosis="), "diagnosis"), F.when(F.col("total") > 0, "lesions=present").otherwise("lesions=none")]
    for b in SIZE_BINS:
        labels += [F.when(F.col(b) > 0, f"has_{b}"), F.when(F.col(b) > 0, F.concat(F.col("dataset"), F.lit(f":has_{b}")))]
    return rows.withColumn("labels", F.array_compact(F.array(*labels)))


_LABELS = _CASE_BINS + """, cl AS (SELECT *, list_filter(['dataset=' || dataset, 'diagnosis=' || diagnosis, CASE WHEN total > 0 THEN 'lesions=present' ELSE 'lesions=none' END,
 CASE WHEN b0 > 0 THEN 'has_0_5mm' END, CASE WHEN b0 > 0 THEN dataset || ':has_0_5mm' END, CASE WHEN b1 > 0 THEN 'has_5_10mm' END, CASE WHEN b1 > 0 THEN dataset || ':has_5_10mm' END,
 CASE WHEN b2 > 0 THEN 'has_10_15mm' END, CASE WHEN b2 > 0 THEN dataset || ':has_10_15mm' END, CASE WHEN b3 > 0 THEN 'has_gt_15mm' END, CASE WHEN b3 > 0 THEN dataset || ':has_gt_15mm' END], lambda l: l IS NOT NULL) AS labels FROM cb)"""  # fmt: skip


@query(_LABELS + " SELECT case_id, array_to_string(labels, ',') AS labels FROM cl")
def case_label_array(spark: SparkSession, d: str) -> DataFrame:
    return case_labels(case_bins(spark, d)).select("case_id", F.array_join("labels", ",").alias("labels"))


@query(_LABELS + " SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM cl) GROUP BY 1")
def label_frequency(spark: SparkSession, d: str) -> DataFrame:
    return case_labels(case_bins(spark, d)).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(_LABELS + " SELECT label, n FROM (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM cl) GROUP BY 1) ORDER BY n, label LIMIT 1")
def rarest_label(spark: SparkSession, d: str) -> DataFrame:
    return label_frequency(spark, d).orderBy("n", "label").limit(1)


_SPLIT = "CASE WHEN case_id % 10 < 7 THEN 'train' WHEN case_id % 10 = 7 THEN 'val' ELSE 'test' END"
_SUM_COLUMNS = ", ".join(f"coalesce(sum(b{i}), 0)::BIGINT AS lesions_{b}, count(*) FILTER (WHERE b{i} > 0) AS cases_with_{b}" for i, b in enumerate(SIZE_BINS))
_SUM_DIAGNOSES = ", ".join(f"count(*) FILTER (WHERE diagnosis = '{x}') AS \"diagnosis_{x}\"" for x in DIAGNOSES)


def split_totals(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """A row for each subset and dataset of `grid`, with zeros where there are no cases."""
    sums = [F.count("*").alias("cases"), F.count_if(F.col("total") > 0).alias("lesion_positive_cases"), F.sum("total").alias("lesions_total")]
    for b in SIZE_BINS:
        sums += [F.sum(b).alias(f"lesions_{b}"), F.count_if(F.col(b) > 0).alias(f"cases_with_{b}")]
    sums += [F.count_if(F.col("diagnosis") == x).alias(f"diagnosis_{x}") for x in DIAGNOSES]
    return grid.join(rows.groupBy("subset", "dataset").agg(*sums), ["subset", "dataset"], "left").fillna(0)


@query(_CASE_BINS + f", sub AS (SELECT unnest(['train', 'val', 'test']) AS subset), ds AS (SELECT DISTINCT dataset FROM cs), sp AS (SELECT *, {_SPLIT} AS subset FROM cb) SELECT subset, dataset, count(case_id) AS cases, count(*) FILTER (WHERE total > 0) AS lesion_positive_cases, coalesce(sum(total), 0)::BIGINT AS lesions_total, {_SUM_COLUMNS}, {_SUM_DIAGNOSES} FROM sub CROSS JOIN ds LEFT JOIN sp USING (subset, dataset) GROUP BY 1, 2")
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = case_bins(spark, d)
    part = F.when(F.col("case_id") % 10 < 7, "train").when(F.col("case_id") % 10 == 7, "val").otherwise("test")
    grid = spark.createDataFrame([("train",), ("val",), ("test",)], "subset string").crossJoin(rows.select("dataset").distinct())  # 3 x datasets
    return split_totals(rows.withColumn("subset", part), grid)


def protocol_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cases with their labels, whether they have small lesions, and whether their masks are clean."""
    rows = case_labels(case_bins(spark, d))
    return rows.select("case_id", "labels", F.exists(F.array(*SIZE_BINS[:1]), lambda n: n > 1).alias("small"), (F.col("case_id") % 7 != 3).alias("clean"))


@query(_LABELS + " SELECT case_id, CASE WHEN case_id % 7 <> 3 THEN CASE WHEN b0 > 1 THEN 'small' ELSE 'pool' END ELSE CASE WHEN b0 > 1 THEN 'excluded' ELSE 'forced' END END AS pool FROM cl")
def split_pools(spark: SparkSession, d: str) -> DataFrame:
    """What each case may be used for, if small lesions are held out and unclean cases only trained on."""
    return splits.pools(protocol_rows(spark, d), "small", "clean").select("case_id", "pool")


@query()
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The split by that protocol. It is a sequential greedy, which SQL does not express; tests compare it with a plain
    version of the same rules."""
    out = splits.split(protocol_rows(spark, d), {"train": 0.7, "val": 0.1, "test": 0.2}, small="small", clean="clean")
    return out.select(F.col("case_id").cast("bigint").alias("case_id"), "subset", "reason")


@query(_LESIONS + ", b AS (SELECT unnest(['0_5mm', '5_10mm', '10_15mm', 'gt_15mm']) AS size_bin), sc AS (SELECT DISTINCT dataset AS scope FROM cs UNION ALL SELECT 'overall') SELECT sc.scope, b.size_bin, count(component) AS lesions FROM sc CROSS JOIN b LEFT JOIN s ON s.size_bin = b.size_bin AND (scope = 'overall' OR s.dataset = scope) GROUP BY 1, 2")
def zero_filled_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows, every = lesion_rows(spark, d), cases(spark, d)
    grid = E.scoped(every, [], F.count("*").alias("cases")).drop("cases").crossJoin(F.broadcast(E.bins_frame(every)))
    counts = E.scoped(rows, ["size_bin"], F.count("*").alias("n"))
    return grid.join(counts, ["scope", "size_bin"], "left").select("scope", "size_bin", F.coalesce("n", F.lit(0)).alias("lesions"))


_REPORT = f""",
bridge AS (SELECT * FROM (VALUES ('0_5mm', '0_5mm'), ('5_10mm', '5_10mm'), ('10_15mm', '10_15mm'), ('gt_15mm', 'gt_15mm'), ('5_15mm', '5_10mm'), ('5_15mm', '10_15mm'), ('all', '0_5mm'), ('all', '5_10mm'), ('all', '10_15mm'), ('all', 'gt_15mm')) b(report_bin, size_bin)),
rb AS (SELECT DISTINCT report_bin FROM bridge),
sc AS (SELECT coalesce(dataset, 'overall') AS scope, count(*) AS cases FROM cs GROUP BY GROUPING SETS ((), (dataset))),
lb AS (SELECT coalesce(dataset, 'overall') AS scope, report_bin, k, count(*) AS lesions, count(*) FILTER (WHERE detected) AS detected FROM les JOIN bridge USING (size_bin) GROUP BY GROUPING SETS ((report_bin, k), (dataset, report_bin, k))),
fb AS (SELECT coalesce(dataset, 'overall') AS scope, report_bin, k, count(*) AS n FROM fp JOIN bridge USING (size_bin) GROUP BY GROUPING SETS ((report_bin, k), (dataset, report_bin, k))),
fr AS (SELECT sc.scope, rb.report_bin, tk.k AS threshold, coalesce(lesions, 0) AS lesions, coalesce(detected, 0) AS detected, coalesce(fb.n, 0) AS fp_in_bin, coalesce(fa.n, 0)::DOUBLE / cases AS fp_per_case
  FROM sc CROSS JOIN rb CROSS JOIN (SELECT unnest({list(LEVELS)}) AS k) tk LEFT JOIN lb ON lb.scope = sc.scope AND lb.report_bin = rb.report_bin AND lb.k = tk.k
  LEFT JOIN fb ON fb.scope = sc.scope AND fb.report_bin = rb.report_bin AND fb.k = tk.k LEFT JOIN fb fa ON fa.scope = sc.scope AND fa.report_bin = 'all' AND fa.k = tk.k)
"""


_CURVE = f"SELECT scope, report_bin, threshold, lesions, detected, round(detected::DOUBLE / nullif(lesions, 0), 6) AS sensitivity, round({_LOW}, 6) + 0.0 AS ci95_low, round({_HIGH}, 6) AS ci95_high, fp_in_bin, round(fp_per_case, 6) AS fp_per_case FROM fr"
_AT_TARGETS = """, pt AS (SELECT scope, report_bin, fp_per_case AS x, detected::DOUBLE / lesions AS y, threshold FROM fr WHERE lesions > 0),
pr AS (SELECT scope, report_bin, row_number() OVER w AS i, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pt WINDOW w AS (PARTITION BY scope, report_bin ORDER BY x, y, threshold DESC)),
tg AS (SELECT unnest([0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS target),
hit AS (SELECT scope, report_bin, target, arg_min(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (target - x0) / (x1 - x0) END, i) AS s FROM pr JOIN tg ON x0 <= target AND target <= x1 GROUP BY 1, 2, 3),
fst AS (SELECT scope, report_bin, target, y0 AS s FROM pr, tg WHERE i = 1 AND abs(x0 - target) < 1e-9)
SELECT g.scope, g.report_bin, g.target, round(coalesce(hit.s, fst.s), 6) AS sensitivity FROM (SELECT DISTINCT scope, report_bin, target FROM fr, tg) g LEFT JOIN hit USING (scope, report_bin, target) LEFT JOIN fst USING (scope, report_bin, target)"""  # fmt: skip


@query(evaluation(SWEEP) + _REPORT + _CURVE)
def froc_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.froc(*swept(spark, d)))


@query(evaluation(SWEEP) + _REPORT + _AT_TARGETS)
def froc_interpolate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.at_targets(E.froc(*swept(spark, d))))


@query(_LESIONS + ", bridge AS (SELECT * FROM (VALUES ('0_5mm', '0_5mm'), ('5_10mm', '5_10mm'), ('10_15mm', '10_15mm'), ('gt_15mm', 'gt_15mm'), ('5_15mm', '5_10mm'), ('5_15mm', '10_15mm'), ('all', '0_5mm'), ('all', '5_10mm'), ('all', '10_15mm'), ('all', 'gt_15mm')) b(report_bin, size_bin)) SELECT report_bin, count(*) AS lesions, count(DISTINCT case_id) AS cases FROM s JOIN bridge USING (size_bin) GROUP BY 1")
def overlapping_bins(spark: SparkSession, d: str) -> DataFrame:
    bridge = spark.createDataFrame([(r, b) for r, bins in E.REPORT_BINS.items() for b in bins], "report_bin string, size_bin string")
    return lesion_rows(spark, d).join(F.broadcast(bridge), "size_bin").groupBy("report_bin").agg(F.count("*").alias("lesions"), F.count_distinct("case_id").alias("cases"))
