"""Angles, guards and small transforms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_TURN = 360.0


def wrap(angle: Column) -> Column:
    """An angle in [0, 360)."""
    return F.pmod(angle, F.lit(FULL_TURN))


def circular_difference(a: Column, b: Column) -> Column:
    """a - b in [-180, 180)."""
    return F.pmod(a - b + 180.0, F.lit(FULL_TURN)) - 180.0


def in_arc(x: Column, low: Column, high: Column, closed: bool = False) -> Column:
    """Whether x lies in [low, high) on the circle, or [low, high]; low above high wraps through 0."""
    below = x <= high if closed else x < high
    return F.when(low <= high, (x >= low) & below).otherwise((x >= low) | below)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle angle in degrees."""
    a, b = F.radians(dec1), F.radians(dec2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(ra1 - ra2))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def log_modulus(x: Column) -> Column:
    """sign(x) log(1 + |x|): tames the growth of signature terms by level."""
    return F.signum(x) * F.log1p(F.abs(x))


def finite(x: Column) -> Column:
    """x, with null, NaN and infinities as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def calendar_year(julian_date: Column) -> Column:
    return F.floor((julian_date - 2451545.0) / 365.25 + 2000.0)


def digits(x: Column, n: int = 5) -> Column:
    """x rounded, without negative zero: for comparing results of two engines."""
    return F.round(x, n) + 0.0


#: Centres of the sporadic sources in sun-centred ecliptic longitude and latitude, degrees. Fixed values.
SPORADIC_SOURCES = {
    "helion": (340.0, 0.0),
    "antihelion": (200.0, 0.0),
    "north_apex": (270.0, 15.0),
    "south_apex": (270.0, -15.0),
    "north_toroidal": (270.0, 60.0),
}


def nearest_source(longitude: Column, latitude: Column) -> Column:
    """struct(distance, place, source) of the nearest sporadic source; of equal ones the first in the table."""
    choices = []
    for i, (name, (lon, lat)) in enumerate(SPORADIC_SOURCES.items()):
        along = F.abs(circular_difference(longitude, F.lit(lon))) * F.cos(F.radians((latitude + lat) * 0.5))
        choices.append(F.struct(F.hypot(along, latitude - lat).alias("distance"), F.lit(i).alias("place"), F.lit(name).alias("source")))
    return F.array_min(F.array(*choices))
