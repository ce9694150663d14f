"""Segmentation of volumes by a model that is handed in, and the choice among passes of it by the vertebrae they find.

The model itself is no part of this package: any function from an array to an array of labels will do, and a table of
labels from elsewhere takes its place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .estimators import LEVELS, MIN_SLICES, PRIOR_EXTENT, PRIOR_PART

AXES = ("z", "y", "x")
# The model's voxels in mm, and what lies outside of a volume.
MODEL_SPACING, OUTSIDE = 3.0, -1024.0
# Levels that a scan of the liver has, and the score that confirms a slice order.
PLAUSIBLE, CONFIRMED = ("T9", "T10", "T11", "T12", "L1", "L2", "L3"), 4
# Range of a guessed spacing in mm; a second pass is due where the mask spans less of the volume than this and
# the guesses differ by more than this factor.
GUESS_RANGE, SPANNED, APART = (0.4, 7.0), 0.4, 1.5
# Where a guess and an orientation come from.
BY_MASK, BY_VOLUME, BY_SECOND = "released_liver_mask_extent", "volume_slice_count", "volume_slice_count_after_failed_mask"
OVERRIDE, SURE, WEAKLY, NOT = "totalsegmentator_vertebra_order_override", "vertebra_order_confirmed", "vertebra_order_weakly_confirmed", "vertebra_order_unconfirmed"


def on_axis(volume: np.ndarray, axis: int, step: float, count: int) -> np.ndarray:
    """Linear interpolation along one axis at `count` places `step` voxels apart from the first; beyond the last: OUTSIDE."""
    at = np.arange(count) * step
    low = np.minimum(at.astype(np.int64), volume.shape[axis] - 1)
    part = (at - low).reshape([-1 if i == axis else 1 for i in range(3)]).astype(np.float32)
    out = volume.take(low, axis) * (1 - part) + volume.take(np.minimum(low + 1, volume.shape[axis] - 1), axis) * part
    out[(slice(None),) * axis + (at > volume.shape[axis] - 1,)] = OUTSIDE
    return out


def model_grid(volume: np.ndarray, spacing: list[float], target: float = MODEL_SPACING) -> np.ndarray:
    """`volume` (z, y, x, LPS; spacing in that order) at `target` mm in the model's axes, where x and y run the other way."""
    out = volume[:, ::-1, ::-1].astype(np.float32)
    for axis, own in enumerate(spacing):
        out = on_axis(out, axis, target / own, max(1, int(np.ceil(out.shape[axis] * own / target - 1e-9))))
    return out


def segmented(volume: DataFrame, grids: DataFrame, model: Callable[[np.ndarray], np.ndarray], target: float = MODEL_SPACING) -> DataFrame:
    """(case_id, z, y, x, label) of what `model` labels above 0, on the model's grid and in its axes.

    `volume`: case_id, z, y, x, value; `grids`: case_id, size and spacing_mm in x, y, z order. Voxels that are not given are
    OUTSIDE. One case a task, as a volume is bounded by its grid; `model` is pickled, so one that is costly to load should load
    itself when first called. A case of `grids` without voxels is handed on empty; voxels without a grid are left out.
    """
    kind = dict(grids.dtypes)["case_id"]

    def run(key: tuple, grid: pa.Table, rows: pa.Table) -> pa.Table:
        size, spacing = (grid.column(c)[0].as_py()[::-1] for c in ("size", "spacing_mm"))
        dense = np.full(size, OUTSIDE, dtype=np.float32)
        dense[tuple(rows.column(a).to_numpy() for a in AXES)] = rows.column("value").to_numpy()
        labels = np.asarray(model(model_grid(dense, spacing, target)))
        at = np.nonzero(labels > 0)
        case = pa.array([key[0].as_py()] * len(at[0]), grid.schema.field("case_id").type)
        return pa.table({"case_id": case, **{a: pa.array(at[i].astype(np.int32)) for i, a in enumerate(AXES)}, "label": pa.array(labels[at].astype(np.int32))})

    grids = grids.select("case_id", "size", F.col("spacing_mm").cast("array<double>").alias("spacing_mm"))
    rows = volume.join(grids.select("case_id"), "case_id", "left_semi").select("case_id", *AXES, F.col("value").cast("float").alias("value"))
    return grids.groupBy("case_id").cogroup(rows.groupBy("case_id")).applyInArrow(run, f"case_id {kind}, z int, y int, x int, label int")


def guesses(mask_slices: Column, volume_slices: Column) -> tuple[Column, Column, Column, Column]:
    """(guess, its source, guess by the volume, whether a second pass with the latter is due), in mm a slice."""
    whole = PRIOR_EXTENT / F.greatest(F.lit(1.0), F.bround(volume_slices * PRIOR_PART))
    usable = mask_slices >= MIN_SLICES
    own, by_volume = clamp(F.when(usable, PRIOR_EXTENT / mask_slices).otherwise(whole), *GUESS_RANGE), clamp(whole, *GUESS_RANGE)
    second = usable & (mask_slices < volume_slices * SPANNED) & (F.abs(F.ln(by_volume / own)) > F.ln(F.lit(APART)))
    return own, F.when(usable, BY_MASK).otherwise(BY_VOLUME), by_volume, F.coalesce(second, F.lit(False))


def consistency(vertebrae: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, order_score, plausible, levels) of each volume that has vertebrae (keys, level, z).

    The score is the number of pairs whose levels rise with z less that of pairs whose levels fall; pairs at one height do
    not count. Levels other than LEVELS are left out. A volume has a handful of levels, so pairs are met within its array.
    """
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    g = vertebrae.withColumn("place", place).where("place > 0").groupBy(*keys).agg(F.collect_list(F.struct("z", "place")).alias("v"), F.count_if(F.col("level").isin(*PLAUSIBLE)).alias("plausible"), F.count("*").alias("levels"))
    zero = F.lit(0).cast("bigint")
    above = lambda low: F.aggregate("v", zero, lambda s, up: s + F.when(up["z"] > low["z"], F.sign(low["place"] - up["place"]).cast("bigint")).otherwise(zero))
    return g.select(*keys, F.aggregate(F.transform("v", above), zero, lambda s, x: s + x).alias("order_score"), "plausible", "levels")


def chosen_pass(passes: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chosen, flip, source, order_score, plausible, levels) of every row of `decided` (keys, flip, source).

    `passes`: keys, kind, order_score, plausible, levels. Kind `second` (by the volume's guess) replaces `first` if its score,
    plausible levels and levels, in that order, are more. If what is left does not confirm the slice order, `other` (the
    slices the other way round, of the pass that was kept) replaces it by score and plausible levels, and turns the flip.
    A pass that was run but found no vertebrae has nulls or zeros, one that was not run has no row and is not chosen; without a
    first pass there are zeros. One aggregate; ties keep the earlier pass.
    """
    fields = ("order_score", "plausible", "levels")
    none = F.struct(*[F.lit(0).cast("bigint").alias(f) for f in fields])
    counted = F.struct(*[F.coalesce(F.col(f).cast("bigint"), F.lit(0)).alias(f) for f in fields])
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, counted)).alias(kind)
    g = passes.groupBy(*keys).agg(pick("first"), pick("second"), pick("other"))
    rows = decided.select(*keys, "flip", "source").join(g, keys, "left").withColumn("first", F.coalesce("first", none))
    again = F.coalesce(F.col("second") > F.col("first"), F.lit(False))
    rows = rows.withColumn("kept", F.when(again, F.col("second")).otherwise(F.col("first")))
    score = F.struct("kept.order_score", "kept.plausible")
    turned = F.col("other").isNotNull() & (F.col("kept.order_score") < CONFIRMED) & (F.struct("other.order_score", "other.plausible") > score)
    rows = rows.withColumn("turned", turned).withColumn("chosen", F.when(turned, "other").when(again, "second").otherwise("first"))
    rows = rows.withColumn("best", F.when(F.col("turned"), F.col("other")).otherwise(F.col("kept")))
    grade = F.when(F.col("kept.order_score") >= CONFIRMED, SURE).when(F.col("kept.order_score") > 0, WEAKLY).otherwise(NOT)
    source = F.when(F.col("turned"), OVERRIDE).otherwise(F.concat_ws("+", "source", grade))
    return rows.select(*keys, "chosen", (F.col("flip") != F.col("turned")).alias("flip"), source.alias("source"), "best.*")
