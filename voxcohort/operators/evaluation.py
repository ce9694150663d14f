"""Lesion detection metrics over labelled voxel relations.

`truth` and `found` are voxel tables with keys, coordinates and `component`. All joins are equi-joins on keys and
coordinates or on component names; nothing is compared pair by pair.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SIZE_BINS, diameter, f1, ratio, size_bin, wilson

HIT_FRACTION = 0.10
# Bins of reports, the last two being unions of others; probabilities of the sweep; targets.
REPORT_BINS = {"0_5mm": ("0_5mm",), "5_10mm": ("5_10mm",), "10_15mm": ("10_15mm",), "gt_15mm": ("gt_15mm",), "5_15mm": ("5_10mm", "10_15mm"), "all": SIZE_BINS}
THRESHOLDS = (0.02, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.98)
FP_TARGETS = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)


def level_of(probability: float) -> int:
    """The smallest of 0..255 that reaches a probability."""
    return math.ceil(255 * probability - 1e-9)


def sizes(components: DataFrame, keys: tuple[str, ...], volume: float) -> DataFrame:
    out = components.groupBy(*keys, "component").agg(F.count("*").alias("voxels"))
    return out.withColumn("esd_mm", diameter(F.col("voxels") * volume)).withColumn("size_bin", size_bin(F.col("esd_mm")))


def overlap(truth: DataFrame, found: DataFrame, keys: tuple[str, ...], found_keys: tuple[str, ...]) -> DataFrame:
    """(found_keys, lesion, piece, voxels): shared voxels of each touching pair."""
    a = truth.select(*keys, "z", "y", "x", F.col("component").alias("lesion"))
    b = found.select(*found_keys, "z", "y", "x", F.col("component").alias("piece"))
    return a.join(b, [*keys, "z", "y", "x"]).groupBy(*found_keys, "lesion", "piece").agg(F.count("*").alias("shared"))


def sized(df: DataFrame, volume: float) -> DataFrame:
    return df.withColumn("esd_mm", diameter(F.col("voxels") * volume)).withColumn("size_bin", size_bin(F.col("esd_mm")))


def lesions_of(table: DataFrame, volume: float) -> DataFrame:
    """As `lesions`, from a contingency table (see components.contingency); with `threshold`.

    Rows outside of lesions are told apart after the aggregate, here and below, so that all readers of the table have one
    plan for it and Spark makes it once.
    """
    keys = ["case_id", "threshold"]
    inside = F.col("piece").isNotNull()
    whole = F.sum("n").over(Window.partitionBy(*keys, "piece"))  # a case's rows lie in one task already
    rows = table.withColumn("piece_voxels", F.when(inside, whole).otherwise(0)).withColumn("shared", F.when(inside, F.col("n")).otherwise(0))
    sums = rows.groupBy(*keys, "lesion").agg(F.sum("n").alias("voxels"), F.sum("shared").alias("covered"), F.sum("piece_voxels").alias("touching"), F.count("lesion").alias("real")).where("real > 0")
    return sized(sums, volume).select(
        *keys, "lesion", "voxels", "esd_mm", "size_bin", "covered", ratio(F.col("covered"), F.col("voxels")).alias("covered_fraction"),
        (F.col("covered") >= F.greatest(F.lit(1.0), HIT_FRACTION * F.col("voxels"))).alias("detected"), ratio(2 * F.col("covered"), F.col("voxels") + F.col("touching")).alias("lesion_dice"),
    )


def false_positives_of(table: DataFrame, volume: float) -> DataFrame:
    pieces = table.groupBy("case_id", "threshold", "piece").agg(F.sum("n").alias("voxels"), F.count("lesion").alias("touched"), F.count("piece").alias("real"))
    return sized(pieces.where("real > 0 and touched = 0").drop("touched", "real"), volume)


def case_totals_of(table: DataFrame, cases: DataFrame) -> DataFrame:
    """As `case_totals`, for a table without thresholds."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g, p = F.col("lesion").isNotNull(), F.col("piece").isNotNull()
    counts = table.groupBy("case_id", "threshold").agg(part(g).alias("gt_voxels"), part(p).alias("pred_voxels"), part(g & p).alias("tp_voxels")).drop("threshold")
    out = cases.join(counts, "case_id", "left").fillna(0, ["gt_voxels", "pred_voxels", "tp_voxels"])
    return out.withColumn("case_dice", ratio(2 * F.col("tp_voxels"), F.col("gt_voxels") + F.col("pred_voxels")))


def lesions(truth: DataFrame, found: DataFrame, keys: tuple[str, ...], found_keys: tuple[str, ...], volume: float, settings: DataFrame | None = None) -> DataFrame:
    """One row for each lesion (and setting): coverage, detection and Dice. `settings` has what found_keys add to keys."""
    both = overlap(truth, found, keys, found_keys)
    pieces = found.groupBy(*found_keys, "component").agg(F.count("*").alias("piece_voxels"))
    # Coverage is summed for each lesion before sizes of pieces come in; a piece may touch several lesions.
    covered = both.join(pieces.withColumnRenamed("component", "piece"), [*found_keys, "piece"]).groupBy(*found_keys, "lesion").agg(F.sum("shared").alias("covered"), F.sum("piece_voxels").alias("touching"))
    known = sizes(truth, keys, volume).withColumnRenamed("component", "lesion")
    if settings is not None:
        known = known.crossJoin(F.broadcast(settings))  # a handful of thresholds
    out = known.join(covered, [*found_keys, "lesion"], "left")
    covered_, touching = F.coalesce("covered", F.lit(0)), F.coalesce("touching", F.lit(0))
    return out.select(
        *found_keys, "lesion", "voxels", "esd_mm", "size_bin", covered_.alias("covered"), ratio(covered_, F.col("voxels")).alias("covered_fraction"),
        (covered_ >= F.greatest(F.lit(1.0), HIT_FRACTION * F.col("voxels"))).alias("detected"), ratio(2 * covered_, F.col("voxels") + touching).alias("lesion_dice"),
    )


def false_positives(truth: DataFrame, found: DataFrame, keys: tuple[str, ...], found_keys: tuple[str, ...], volume: float) -> DataFrame:
    """Found components that touch no lesion."""
    touched = found.join(truth.select(*keys, "z", "y", "x"), [*keys, "z", "y", "x"], "left_semi").select(*found_keys, "component").distinct()
    return sizes(found, found_keys, volume).join(touched, [*found_keys, "component"], "left_anti")


def case_totals(cases: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """gt_voxels, pred_voxels, tp_voxels and case_dice of every case; Dice is null where both masks are empty."""
    marks = truth.select("case_id", "z", "y", "x", F.lit(1).alias("g")).join(found.select("case_id", "z", "y", "x", F.lit(1).alias("p")), ["case_id", "z", "y", "x"], "full_outer")
    counts = marks.groupBy("case_id").agg(F.count("g").alias("gt_voxels"), F.count("p").alias("pred_voxels"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp_voxels"))
    out = cases.join(counts, "case_id", "left").fillna(0, ["gt_voxels", "pred_voxels", "tp_voxels"])
    return out.withColumn("case_dice", ratio(2 * F.col("tp_voxels"), F.col("gt_voxels") + F.col("pred_voxels")))


def case_totals_marked(cases: DataFrame, voxels: DataFrame, truth: str = "gt", found: str = "pred") -> DataFrame:
    """As `case_totals`, where both masks are flags of the same voxels: one scan and one aggregate, without a join."""
    g, p = F.col(truth), F.col(found)
    counts = voxels.where(g | p).groupBy("case_id").agg(F.count_if(g).alias("gt_voxels"), F.count_if(p).alias("pred_voxels"), F.count_if(g & p).alias("tp_voxels"))
    out = cases.join(counts, "case_id", "left").fillna(0, ["gt_voxels", "pred_voxels", "tp_voxels"])
    return out.withColumn("case_dice", ratio(2 * F.col("tp_voxels"), F.col("gt_voxels") + F.col("pred_voxels")))


def scoped(df: DataFrame, by: list[str], *aggregates) -> DataFrame:
    """The aggregates over everything ("overall") and for each dataset, in one pass."""
    out = df.groupingSets([by, ["dataset", *by]], "dataset", *by).agg(*aggregates, F.grouping("dataset").alias("__all"))
    return out.withColumn("scope", F.when(F.col("__all") == 1, "overall").otherwise(F.col("dataset"))).drop("dataset", "__all")


def bins_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(b,) for b in SIZE_BINS], "size_bin string")


def detection_metrics(cases: DataFrame, lesion_rows: DataFrame, fp_rows: DataFrame) -> DataFrame:
    """A row for each scope and size bin, empty bins included. The tables have `dataset`."""
    grid = scoped(cases, [], F.count("*").alias("cases")).crossJoin(F.broadcast(bins_frame(cases)))  # scopes x 4
    hits = scoped(lesion_rows, ["size_bin"], F.count("*").alias("lesions"), F.count_if("detected").alias("detected"), F.sum("voxels").alias("gt"), F.sum("covered").alias("cov"), F.avg("lesion_dice").alias("lesion_dice_mean"))
    misses = scoped(fp_rows, ["size_bin"], F.count("*").alias("false_positive_components"))
    out = grid.join(hits, ["scope", "size_bin"], "left").join(misses, ["scope", "size_bin"], "left").fillna(0, ["lesions", "detected", "false_positive_components"])
    low, high = wilson(F.col("detected"), F.col("lesions"))
    return out.select(
        "scope", "size_bin", "cases", "lesions", "detected", ratio(F.col("detected"), F.col("lesions")).alias("sensitivity"), low.alias("ci95_low"), high.alias("ci95_high"),
        ratio(F.col("detected"), F.col("detected") + F.col("false_positive_components")).alias("lesion_precision"), ratio(F.col("cov"), F.col("gt")).alias("voxel_recall"), "lesion_dice_mean", "false_positive_components",
    )


def overall_metrics(cases: DataFrame, lesion_rows: DataFrame, fp_rows: DataFrame, totals: DataFrame) -> DataFrame:
    """A row for each scope: recall, precision and F1 of lesions, pooled voxel metrics, mean Dice, false positives a case."""
    grid = scoped(cases, [], F.count("*").alias("cases"))
    hits = scoped(lesion_rows, [], F.count("*").alias("lesions"), F.count_if("detected").alias("detected"))
    misses = scoped(fp_rows, [], F.count("*").alias("false_positive_components"))
    sums = scoped(totals, [], F.sum("tp_voxels").alias("tp"), F.sum("gt_voxels").alias("gt"), F.sum("pred_voxels").alias("pred"), F.avg("case_dice").alias("case_tumour_dice_mean"))
    out = grid.join(hits, "scope", "left").join(misses, "scope", "left").join(sums, "scope", "left").fillna(0, ["lesions", "detected", "false_positive_components"])
    out = out.withColumn("recall", ratio(F.col("detected"), F.col("lesions"))).withColumn("precision", ratio(F.col("detected"), F.col("detected") + F.col("false_positive_components")))
    return out.withColumn("f1", f1(F.col("recall"), F.col("precision"))).select(
        "scope", "cases", "lesions", "detected", "false_positive_components", "recall", "precision", "f1", "case_tumour_dice_mean", ratio(F.col("false_positive_components"), F.col("cases")).alias("fp_per_case"),
        ratio(F.col("tp"), F.col("gt")).alias("voxel_recall_pooled"), ratio(F.col("tp"), F.col("pred")).alias("voxel_precision_pooled"), ratio(2 * F.col("tp"), F.col("gt") + F.col("pred")).alias("voxel_dice_pooled"),
    )


def froc(cases: DataFrame, lesion_rows: DataFrame, fp_rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """A row for each scope, report bin and threshold; false positives a case are over all sizes."""
    spark = cases.sparkSession
    bridge = F.broadcast(spark.createDataFrame([(r, b) for r, bins in REPORT_BINS.items() for b in bins], "report_bin string, size_bin string"))
    grid = scoped(cases, [], F.count("*").alias("cases")).crossJoin(F.broadcast(thresholds)).crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in REPORT_BINS], "report_bin string")))
    hits = scoped(lesion_rows.join(bridge, "size_bin"), ["report_bin", "threshold"], F.count("*").alias("lesions"), F.count_if("detected").alias("detected"))
    misses = scoped(fp_rows.join(bridge, "size_bin"), ["report_bin", "threshold"], F.count("*").alias("fp_in_bin"))
    every = misses.where("report_bin = 'all'").select("scope", "threshold", F.col("fp_in_bin").alias("fp_all"))
    out = grid.join(hits, ["scope", "report_bin", "threshold"], "left").join(misses, ["scope", "report_bin", "threshold"], "left").join(every, ["scope", "threshold"], "left")
    out = out.fillna(0, ["lesions", "detected", "fp_in_bin", "fp_all"])
    low, high = wilson(F.col("detected"), F.col("lesions"))
    return out.select("scope", "report_bin", "threshold", "lesions", "detected", ratio(F.col("detected"), F.col("lesions")).alias("sensitivity"), low.alias("ci95_low"), high.alias("ci95_high"), "fp_in_bin", ratio(F.col("fp_all"), F.col("cases")).alias("fp_per_case"))


def at_targets(curve: DataFrame, targets: tuple[float, ...] = FP_TARGETS) -> DataFrame:
    """Sensitivity at each target of false positives a case, from the first bracketing pair of points; null outside."""
    points = curve.where("sensitivity is not null").select("scope", "report_bin", "fp_per_case", "sensitivity", "threshold")
    w = Window.partitionBy("scope", "report_bin").orderBy("fp_per_case", "sensitivity", F.desc("threshold"))
    pairs = points.select("scope", "report_bin", F.row_number().over(w).alias("i"), F.col("fp_per_case").alias("x0"), F.col("sensitivity").alias("y0"), F.lead("fp_per_case").over(w).alias("x1"), F.lead("sensitivity").over(w).alias("y1"))
    wanted = F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    asked = pairs.select("*", wanted)
    inside = (F.col("x0") <= F.col("target")) & (F.col("target") <= F.col("x1"))
    value = F.when(F.col("x1") == F.col("x0"), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * F.try_divide(F.col("target") - F.col("x0"), F.col("x1") - F.col("x0")))
    first = F.when((F.col("i") == 1) & (F.abs(F.col("x0") - F.col("target")) < 1e-9), F.col("y0"))
    found = asked.groupBy("scope", "report_bin", "target").agg(F.min_by(F.when(inside, value), F.when(inside, F.col("i"))).alias("bracket"), F.max(first).alias("first"))
    grid = curve.select("scope", "report_bin").distinct().select("*", wanted)
    return grid.join(found, ["scope", "report_bin", "target"], "left").select("scope", "report_bin", "target", F.coalesce("bracket", "first").alias("sensitivity"))
