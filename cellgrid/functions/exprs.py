"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: microscope constants and emission maxima in nm
PIXEL_UM = 0.325
VOXEL_NM = 325.0
NUMERICAL_APERTURE = 1.15
EMISSION_NM = {
    "Atto 425": 484, "Alexa Fluor 488": 525, "Alexa Fluor 546": 572,
    "Alexa Fluor 594": 618, "Alexa Fluor 647": 671,
}
#: double-precision machine epsilon, added to denominators
EPS = 2.220446049250313e-16


def psf_sigma(fluorophore: str) -> float:
    """Gaussian width of the point-spread function in voxels."""
    return 0.21 * EMISSION_NM[fluorophore] / NUMERICAL_APERTURE / VOXEL_NM


def clip(c: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(c, lo), hi)


def non_negative(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def finite_or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def hash32(*parts: Column) -> Column:
    """Unsigned 32-bit number from md5 of the '|'-joined parts; engine independent."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def int_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def cubic_bspline(a: Column) -> list[Column]:
    """The four cubic B-spline weights at offset ``a`` in [0, 1]."""
    b = F.lit(1.0) - a
    return [
        b * b * b / 6.0,
        (3.0 * a * a * a - 6.0 * a * a + 4.0) / 6.0,
        (-3.0 * a * a * a + 3.0 * a * a + 3.0 * a + 1.0) / 6.0,
        a * a * a / 6.0,
    ]


def cubic_bspline_slope(a: Column) -> list[Column]:
    b = F.lit(1.0) - a
    return [
        b * b / -2.0,
        (9.0 * a * a - 12.0 * a) / 6.0,
        (-9.0 * a * a + 6.0 * a + 3.0) / 6.0,
        a * a / 2.0,
    ]


def pick(options: list[Column], index: Column) -> Column:
    """options[index] for a small 0-based index column."""
    return F.element_at(F.array(*options), index.cast("int") + 1)


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised weights of a window of size 6*sigma, centred."""
    half = math.ceil(6 * sigma / 2)
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def rounded_rank(n: Column, fraction: float) -> Column:
    return F.rint(n * F.lit(fraction))


def array_of(name: str, n: int) -> list[Column]:
    return [F.col(f"{name}{i}") for i in range(n)]
