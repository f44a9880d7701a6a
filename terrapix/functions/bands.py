"""Per-pixel band algebra: indices, ratios, radiometry. Every function takes and returns columns; null in, null out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the bands cancel out."""
    return F.try_divide(a - b, a + b)


def vari(green: Column, red: Column, blue: Column) -> Column:
    """Visible atmospherically resistant index."""
    return F.try_divide(green - red, green + red - blue)


def green_chromatic(red: Column, green: Column, blue: Column) -> Column:
    """Green's share of the three visible bands."""
    return F.try_divide(green, red + green + blue)


def excess_green(red: Column, green: Column, blue: Column) -> Column:
    return 2 * green - (red + blue)


def triangular_greenness(red: Column, green: Column, blue: Column, wl_red: float, wl_green: float, wl_blue: float) -> Column:
    """Area of the triangle that three bands span over their wavelengths."""
    return ((wl_red - wl_blue) * (red - green) - (wl_red - wl_green) * (red - blue)) / 2


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def log_ratio(a: Column, b: Column, scale: float = 1000.0) -> Column:
    """Ratio of logarithms of scaled bands, null unless both logarithms exist and the lower isn't 0."""
    ok = (a > 0) & (b > 0)
    return F.when(ok, F.try_divide(F.ln(a * scale), F.ln(b * scale)))


def optical_depth(red_edge: Column, slope: float = -0.251, intercept: float = 0.8) -> Column:
    """Depth to which light reaches, from the logarithm of a red-edge band."""
    return F.when(red_edge > 0, slope * F.ln(red_edge) + intercept)


def radiance(dn: Column, gain: Column, offset: Column, abs_cal: Column, bandwidth: Column) -> Column:
    """Digital numbers to radiance at the top of the atmosphere."""
    return gain * dn * F.try_divide(abs_cal, bandwidth) + offset


def earth_sun_distance(ts: Column, degrees_in_second_term: bool = False) -> Column:
    """In astronomical units, from the Julian date of a UTC time.

    degrees_in_second_term: take the second cosine of degrees as if they were radians, as some processing chains do.
    """
    month, year = F.month(ts), F.year(ts)
    early = month <= 2
    y, m = F.when(early, year - 1).otherwise(year), F.when(early, month + 12).otherwise(month)
    hours = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    a = F.floor(y / 100)
    julian = F.floor(365.25 * (y + 4716)) + F.floor(30.6001 * (m + 1)) + F.dayofmonth(ts) + hours / 24.0 + (2 - a + F.floor(a / 4)) - 1524.5
    g = 357.529 + 0.98560028 * (julian - 2451545.0)
    second = F.cos(2 * g) if degrees_in_second_term else F.cos(F.radians(2 * g))
    return 1.00014 - 0.01671 * F.cos(F.radians(g)) - 0.00014 * second


def solar_zenith(elevation: Column) -> Column:
    """Radians, from the sun's elevation in degrees."""
    return F.radians(90.0 - elevation)


def toa_reflectance(rad: Column, distance: Column, irradiance: Column, zenith: Column) -> Column:
    """Radiance to reflectance; no data (0) stays null."""
    return F.when(rad != 0, F.try_divide(rad * distance * distance * math.pi, irradiance * F.cos(zenith)))


def scale(band: Column, by: float = 10000.0) -> Column:
    return band / by


def l2_norm(bands: Sequence[Column]) -> Column:
    return F.sqrt(sum((b * b for b in bands[1:]), bands[0] * bands[0]))


def one_hot(cls: Column, values: Sequence[str]) -> list[Column]:
    """A 0/1 column for each value."""
    return [F.when(cls == v, 1).otherwise(0).alias(f"is_{v}") for v in values]


def clamp_low(band: Column, low: float = 0.0, to: Column | None = None) -> Column:
    """Values under `low` become `to` (null by default)."""
    return F.when(band >= low, band).otherwise(F.lit(None).cast("double") if to is None else to)


def mask(band: Column, nodata: float | None = 0.0) -> Column:
    """One null for every kind of missing value: null, NaN, infinite, and the given no-data value."""
    bad = F.isnan(band) | (F.abs(band) == float("inf"))
    if nodata is not None:
        bad = bad | (band == nodata)
    return F.when(~bad, band)


def argmax_name(columns: dict[str, Column], tie: str | None = None) -> Column:
    """Name of the largest column; the first of equals, or `tie` where several are largest."""
    best = F.greatest(*columns.values()) if len(columns) > 1 else next(iter(columns.values()))
    out = F.lit(None).cast("string")
    for name, c in reversed(columns.items()):
        out = F.when(c == best, F.lit(name)).otherwise(out)
    if tie is not None:
        n = sum((F.when(c == best, 1).otherwise(0) for c in columns.values()), F.lit(0))
        out = F.when(n > 1, F.lit(tie)).otherwise(out)
    return out
