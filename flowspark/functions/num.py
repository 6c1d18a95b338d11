"""Numeric column helpers: null-safe clipping, ratios, spectral indices, decay weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


# Shifts exact decimal ties off the rounding boundary, far above floating-point noise.
TIE_SHIFT = 1.7e-9


def rnd(x: Column, digits: int = 6) -> Column:
    """Round for comparison: stable on exact ties, negative zero folded into zero."""
    x = x.cast("double") + TIE_SHIFT
    return F.when(F.abs(x) < 0.5 * 10.0**-digits, F.lit(0.0)).otherwise(F.round(x, digits))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clip, null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def ratio(a: Column, b: Column) -> Column:
    return a / (b + EPS)


def reflectance(dn: Column, mult: Column, add: Column, sun_elev_deg: Column) -> Column:
    """Digital number to top-of-atmosphere reflectance; 0 is no data (P-19)."""
    rho = (mult * dn + add) / F.sin(F.radians(sun_elev_deg))
    return F.when(dn != 0, clip(rho, 0.0, 1.0))


def norm_diff(a: Column, b: Column) -> Column:
    """Normalised difference, null where the sum vanishes (P-20)."""
    return F.when(F.abs(a + b) > 1e-6, (a - b) / (a + b))


def gaussian_decay(d2: Column, sigma: float = 1.5) -> Column:
    return F.exp(-d2 / (sigma * sigma))


def hop_decay(hops: Column, sigma: float = 3.0) -> Column:
    return F.exp(-hops / sigma)


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32) * 5 / 9
