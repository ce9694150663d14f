"""Scalar definitions of the imaging domain, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed upper bounds of the size bins in mm, and their spellings.
SIZE_BINS = ("0_5mm", "5_10mm", "10_15mm", "gt_15mm")
BOUNDS = (5.0, 10.0, 15.0)
# Intensity window, registration clip, 16-bit range, gates.
WINDOW = (-200.0, 200.0)
CLIP = (-200.0, 300.0)
INT16 = (-32768, 32767)
DICE_GATE, AXIS_SCALE = 0.80, (0.85, 1.18)
NULL_TOKENS = ("", "NA", "N/A", "NONE", "NULL")


def diameter(volume: Column) -> Column:
    """Diameter in mm of the sphere with this volume in mm3."""
    return F.pow(volume * (6.0 / math.pi), F.lit(1 / 3))


def size_bin(mm: Column) -> Column:
    out = F.when(mm <= BOUNDS[0], SIZE_BINS[0])
    for bound, name in zip(BOUNDS[1:], SIZE_BINS[1:], strict=False):
        out = out.when(mm <= bound, name)
    return out.when(mm.isNotNull(), SIZE_BINS[-1])


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(recall: Column, precision: Column) -> Column:
    """Null where either is null or 0."""
    return F.when((recall > 0) & (precision > 0), 2 * recall * precision / (recall + precision))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, null for n = 0."""
    p, m = ratio(k, n), n.cast("double")
    scale = 1 + F.try_divide(F.lit(z * z), m)
    centre = (p + F.try_divide(F.lit(z * z), 2 * m)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), m) + F.try_divide(F.lit(z * z), 4 * m * m)) / scale
    return centre - half, centre + half


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def intensity(v: Column) -> Column:
    """0..255 back to the window that it was stored with."""
    return clamp(v, 0.0, 255.0) / 255.0 * (WINDOW[1] - WINDOW[0]) + WINDOW[0]


def int16(v: Column) -> Column:
    """Rounded half to even, then saturated."""
    return clamp(F.rint(v), *map(float, INT16)).cast("int")


def absent(token: Column) -> Column:
    """The token, or null if it spells out that there is none."""
    return F.when(~F.upper(F.trim(token)).isin(*NULL_TOKENS), token)


def log_ratio(a: Column, b: Column) -> Column:
    return F.abs(F.ln(a.cast("double") / b.cast("double")))
