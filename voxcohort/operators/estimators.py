"""Order statistics and decisions over small ordered profiles and measurement sets.

A profile is an array of doubles by slice; its length is bounded by the number of slices of a volume. A patient has a
handful of phases, so what is decided for one is an aggregate over few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Smallest usable profile, margins of the slice-order decision, samples of a correlation.
MIN_SLICES, RELATIVE_MARGIN, STRONG_EVIDENCE, SAMPLES = 8, 0.05, 0.30, 100
# Phase disagreement, prior extent of the liver in mm, its part of a volume's slices.
INCONSISTENT, PRIOR_EXTENT, PRIOR_PART = 0.15, 170.0, 0.96
# A released mask is small under so many slices or so much of the segmented ones.
SMALL_PART = 0.6
# Levels from top to bottom, and the distance in mm between the centres of neighbours.
LEVELS = ("T5", "T6", "T7", "T8", "T9", "T10", "T11", "T12", "L1", "L2", "L3", "L4", "L5")
PAIRS = (
    ("T7", "T8", 23.5),
    ("T8", "T9", 24.5),
    ("T9", "T10", 25.5),
    ("T10", "T11", 27.0),
    ("T11", "T12", 29.0),
    ("T12", "L1", 31.5),
    ("L1", "L2", 33.5),
    ("L2", "L3", 35.0),
    ("L3", "L4", 35.5),
    ("L4", "L5", 35.0),
)
GENERIC_PAIR, GENERIC_RANGE = 30.0, (0.5, 1.6)
# How a spacing was found.
SHARED, PRIOR, OWN_WINS, OWN_ONLY, COUNT = (
    "vertebrae_shared_liver_extent",
    "liver_prior_shared_liver_extent",
    "vertebrae_this_phase_liver_extent_inconsistent",
    "vertebrae_this_phase_only",
    "volume_slice_count_prior",
)
# Where an orientation comes from.
STRONG, WEAK, DEFAULT = "liver_profile", "liver_profile_weak", "dataset_default_no_liver_profile"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, ties: list[str]) -> DataFrame:
    """The lower weighted median: the first value whose cumulative weight reaches half of the total."""
    order = Window.partitionBy(*keys).orderBy(value, *ties)
    running = F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(weight).over(Window.partitionBy(*keys))
    ranked = df.withColumn("__run", running).withColumn("__total", total)
    return ranked.where(F.col("__run") >= F.col("__total") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def asymmetry(profile: Column) -> Column:
    """Rise at the low end less rise at the high end, relative to the peak; 0 for short profiles."""
    n = F.size(profile)
    w = F.greatest(F.lit(2), F.floor(n / 5).cast("int"))
    peak = F.greatest(F.lit(1.0), F.array_max(profile))
    low = (F.get(profile, w) - F.get(profile, F.lit(0))) / peak
    high = (F.get(profile, n - 1 - w) - F.get(profile, n - 1)) / peak
    return F.when(n < MIN_SLICES, 0.0).otherwise(low - high)


def interpolated(profile: Column, samples: int = SAMPLES) -> Column:
    """The profile at `samples` equally spaced positions, linear between slices."""
    n = F.size(profile)

    def at(i: Column) -> Column:
        x = i * (n - 1) / F.lit(samples - 1)
        k = F.least(F.floor(x).cast("int"), F.greatest(n - 2, F.lit(0)))
        a = F.get(profile, k)
        return a + (F.coalesce(F.get(profile, k + 1), a) - a) * (x - k)

    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), at)


def correlation(a: Column, b: Column, constant: float = 0.0) -> Column:
    """Pearson correlation of two arrays of one length; `constant` where either is constant."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    centred = lambda x: let(total(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    both = F.struct(centred(a).alias("a"), centred(b).alias("b"))
    return let(both, lambda s: F.coalesce(F.try_divide(product(s["a"], s["b"]), F.sqrt(product(s["a"], s["a"]) * product(s["b"], s["b"]))), F.lit(constant)))


def trimmed(profile: Column) -> Column:
    """From the first to the last entry above 0."""
    filled = F.transform(profile, lambda v, i: F.when(v > 0, i))
    first, last = F.array_min(filled), F.array_max(filled)
    return F.when(first.isNull(), F.slice(profile, 1, 0)).otherwise(F.slice(profile, first + 1, last - first + 1))


def compared(profiles: DataFrame, key: str, preferred: str, vocabulary: tuple[str, ...] = (), constant: float = 0.0) -> DataFrame:
    """`profiles` (key, phase, profile: trimmed) with usable, reference, direct, reversed and relative_flip.

    The reference is the preferred phase if it is usable, else the longest usable one, ties to the first of the vocabulary, or by name. A phase
    runs the other way round if its reversed profile is clearly more like the reference. Nulls where there is nothing to
    compare. Constant profiles have `constant` both ways, 0 or NaN, and are not turned.
    """
    usable = F.size("profile") >= MIN_SLICES
    place = F.array_position(F.array(*map(F.lit, vocabulary)), F.col("phase")) if vocabulary else F.lit(0)
    sized = profiles.where(usable).groupBy(key, F.size("profile").alias("n_slices"), (F.col("phase") == preferred).alias("is_preferred")).agg(F.min(F.struct(place.alias("place"), "phase")).alias("first"))
    best = sized.groupBy(key).agg(F.max_by("first.phase", F.struct("is_preferred", "n_slices")).alias("reference"))
    rows = profiles.withColumn("usable", usable).join(best, key, "left")
    model = profiles.select(key, F.col("phase").alias("reference"), F.col("profile").alias("model"))
    rows = rows.join(model, [key, "reference"], "left")
    asked = F.col("usable") & (F.col("phase") != F.col("reference"))
    pair = F.when(asked, F.struct(interpolated(F.col("profile")).alias("a"), interpolated(F.col("model")).alias("b")))
    found = rows.withColumn("pair", pair).withColumn("direct", F.when(asked, correlation(F.col("pair.a"), F.col("pair.b"), constant))).withColumn("reversed", F.when(asked, correlation(F.reverse("pair.a"), F.col("pair.b"), constant)))
    flip = F.coalesce(F.col("reversed") > F.col("direct") + RELATIVE_MARGIN, F.lit(False))
    return found.drop("pair", "model").withColumn("relative_flip", flip)


def orientation(profiles: DataFrame, key: str, preferred: str, vocabulary: tuple[str, ...] = (), constant: float = 0.0) -> DataFrame:
    """Per phase whether the stored slice order must be reversed (see `compared`).

    All usable profiles of a patient vote on the reference's order by their margins, those that run the other way round
    with the sign turned; no evidence either way counts as reversed. Without any usable profile all phases are reversed.
    """
    rows = compared(profiles, key, preferred, vocabulary, constant).withColumn("margin", F.when(F.col("usable"), asymmetry(F.col("profile"))).otherwise(0.0))
    vote = F.when(F.col("relative_flip"), -F.col("margin")).otherwise(F.col("margin"))
    # Summed in the order of phases, so that a vote of exactly 0 is 0 on every run.
    votes = rows.where("usable").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("phase", vote.alias("v")))).alias("votes"))  # a phase each
    evidence = F.aggregate("votes", F.lit(0.0), lambda s, x: s + x["v"])
    rows = rows.join(votes.select(key, evidence.alias("evidence")), key, "left")
    source = F.when(F.col("evidence").isNull(), DEFAULT).when(F.abs("evidence") >= STRONG_EVIDENCE, STRONG).otherwise(WEAK)
    flip = F.coalesce((F.col("evidence") >= 0) != F.col("relative_flip"), F.lit(True))
    return rows.select(key, "phase", flip.alias("flip"), source.alias("source"), "margin", "relative_flip", "direct", "reversed", F.coalesce("evidence", F.lit(0.0)).alias("evidence"))


def vertebra_spacing(vertebrae: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """(keys, spacing, pairs, specific) from the distances of consecutive vertebrae.

    `vertebrae`: keys, level, z (centre in slices), guess (mm a slice, the same for all of a volume), touches_edge. Those
    that the volume cuts are left out. Going up, a pair of neighbouring levels has its own reference distance; another
    pair in the right order has the generic one if its distance by the guess is plausible. Spacing is the sum of
    references over that of slices, of the specific pairs if there are any. Volumes without pairs have no row.
    """
    spark = vertebrae.sparkSession
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    up = Window.partitionBy(*keys).orderBy("z", "level")
    rows = vertebrae.where(~F.col("touches_edge")).withColumn("place", place)
    rows = rows.select(*keys, F.col("level").alias("lower"), F.col("place").alias("below"), F.lead("level").over(up).alias("upper"), F.lead("place").over(up).alias("above"), (F.lead("z").over(up) - F.col("z")).alias("slices"), "guess")
    known = F.broadcast(spark.createDataFrame(list(PAIRS), "upper string, lower string, mm double"))
    pairs = rows.where("slices > 0").join(known, ["upper", "lower"], "left")
    plausible = (F.col("above") < F.col("below")) & (F.col("slices") * F.col("guess")).between(GENERIC_RANGE[0] * GENERIC_PAIR, GENERIC_RANGE[1] * GENERIC_PAIR)
    pairs = pairs.withColumn("generic", F.when(F.col("mm").isNull() & plausible, F.lit(GENERIC_PAIR)))
    sums = [f(c).alias(n) for n, f, c in (("a", F.sum, F.col("mm")), ("as", F.sum, F.when(F.col("mm").isNotNull(), F.col("slices"))), ("an", F.count, F.col("mm")), ("b", F.sum, F.col("generic")), ("bs", F.sum, F.when(F.col("generic").isNotNull(), F.col("slices"))), ("bn", F.count, F.col("generic")))]
    out = pairs.groupBy(*keys).agg(*sums).where("an + bn > 0")
    specific = F.col("an") > 0
    ratio = F.when(specific, F.try_divide(F.col("a"), F.col("as"))).otherwise(F.try_divide(F.col("b"), F.col("bs")))
    return out.select(*keys, (ratio * scale).alias("spacing"), F.when(specific, F.col("an")).otherwise(F.col("bn")).alias("pairs"), specific.alias("specific"))


def liver_slices(released: Column, segmented: Column) -> Column:
    """Slices that the liver spans: of the released mask, of the segmentation where that mask is small, else 0."""
    small = (released < MIN_SLICES) | (released < SMALL_PART * F.coalesce(segmented, F.lit(0)))
    return F.when(small & (F.coalesce(segmented, F.lit(0)) > 0), segmented).when(released >= MIN_SLICES, released).otherwise(0)


def fuse(phases: DataFrame, key: str) -> DataFrame:
    """One spacing for each phase of a patient from shared and own estimates.

    `phases`: key, phase, own (mm, null if none), pairs, specific, slices (of the liver), size_z (of the volume).
    The rules, first that holds:

    | the phase has | spacing | basis |
    |---|---|---|
    | liver, and two specific pairs that disagree with the shared extent | own | OWN_WINS |
    | liver, and some phase has an extent | shared extent / slices | SHARED |
    | liver | prior extent / slices | PRIOR |
    | own pairs | own | OWN_ONLY |
    | nothing | prior extent / the part of the volume's slices that a liver spans | COUNT |

    Confidence of own spacings is medium from two specific pairs on, else low; of others high if two phases or more agree
    within 10 %, medium within 20 %, else low.
    """
    sure = F.col("specific") & (F.col("pairs") >= 2)
    apart = lambda a, b: F.abs(F.ln(a / b)) > math.log(1 + INCONSISTENT)
    extent = F.when(F.col("own").isNotNull() & (F.col("slices") > 0), F.col("own") * F.col("slices"))
    rows = phases.withColumn("extent", extent).withColumn("weight", F.col("pairs") * F.when(F.col("specific"), 2.0).otherwise(1.0))
    shared = weighted_median(rows.where("extent is not null"), [key], "extent", "weight", ["phase"])
    rows = rows.join(shared.withColumnRenamed("weighted_median", "shared"), key, "left")
    agreed = F.when(F.col("extent").isNotNull() & ~F.coalesce(sure & apart(F.col("extent"), F.col("shared")), F.lit(False)), F.col("extent"))
    spread = rows.withColumn("agreed", agreed).groupBy(key).agg(F.count("agreed").alias("consistent"), F.max("agreed").alias("high"), F.min("agreed").alias("low"))
    rows = rows.join(spread, key)
    common = F.coalesce("shared", F.lit(PRIOR_EXTENT)) / F.col("slices")
    basis = (
        F.when((F.col("slices") > 0) & F.coalesce(sure & apart(F.col("own"), common), F.lit(False)), OWN_WINS)
        .when((F.col("slices") > 0) & F.col("shared").isNotNull(), SHARED).when(F.col("slices") > 0, PRIOR)
        .when(F.col("own").isNotNull(), OWN_ONLY).otherwise(COUNT)
    )
    spread = F.when(F.col("shared").isNotNull(), F.when(F.col("consistent") > 1, (F.col("high") - F.col("low")) / F.col("shared")).otherwise(0.0))
    rows = rows.withColumn("basis", basis).withColumn("spread", spread)
    own = F.col("basis").isin(OWN_WINS, OWN_ONLY)
    spacing = F.when(own, F.col("own")).when(F.col("slices") > 0, common).otherwise(PRIOR_EXTENT / F.greatest(F.lit(1.0), F.rint(F.col("size_z") * PRIOR_PART)))
    grade = (
        F.when(own, F.when(sure, "medium").otherwise("low"))
        .when((F.col("consistent") >= 2) & (F.col("spread") <= 0.10), "high").when(F.col("spread") <= 0.20, "medium").otherwise("low")
    )
    return rows.select(key, "phase", spacing.alias("spacing"), "basis", grade.alias("confidence"), "spread")
