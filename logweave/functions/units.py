"""Unit conversions and spreadsheet serials as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exact definitions of the units.
METRES_PER_FOOT = 0.3048
KILOGRAMS_PER_POUND = 0.45359237
PASCALS_PER_PSI = 6894.757293168361
PASCALS_PER_BAR = 100_000
LITRES_PER_CUBIC_FOOT = 28.316846592
KELVIN_AT_ZERO_CELSIUS = 273.15
#: Day 0 of spreadsheet serials.
SERIAL_ZERO = "1899-12-30"


def feet_to_metres(c: Column) -> Column:
    return c * METRES_PER_FOOT


def fahrenheit_to_celsius(c: Column) -> Column:
    return (c - 32) * F.lit(5 / 9)


def kelvin_to_celsius(c: Column) -> Column:
    return c - KELVIN_AT_ZERO_CELSIUS


def pounds_to_kilograms(c: Column) -> Column:
    return c * KILOGRAMS_PER_POUND


def psi_to_bar(c: Column) -> Column:
    return c * PASCALS_PER_PSI / PASCALS_PER_BAR


def cubic_feet_to_litres(c: Column) -> Column:
    return c * LITRES_PER_CUBIC_FOOT


def serial_to_date(c: Column) -> Column:
    """The date of a spreadsheet serial; its fraction, the time of day, is left out. Null outside 1 to 100,000."""
    return F.when((c > 1) & (c < 100_000), F.date_add(F.lit(SERIAL_ZERO).cast("date"), F.floor(c).cast("int")))


def fraction_to_seconds(c: Column) -> Column:
    """Seconds of a day fraction from 0 up to 1 (halves go up); null for others."""
    return F.when((c >= 0) & (c < 1), F.floor(c * 86_400 + 0.5).cast("long"))


def next_milestone(count: Column) -> Column:
    """The next count worth a mention: steps of 25 below 100, of 50 below 500, of 100 from there on."""
    step = F.when(count < 100, 25).when(count < 500, 50).otherwise(100)
    return F.when(count >= 0, (F.floor(count / step) + 1) * step).cast("long")


def surface_air(start_bar: Column, end_bar: Column, litres: Column, minutes: Column, mean_depth_m: Column) -> Column:
    """Litres a minute at the surface: (start - end) * tank volume / minutes / (1 + depth / 10).

    Null unless the pressure falls, the volume and the time are above zero and the depth is not negative.
    """
    sound = (start_bar >= end_bar) & (end_bar >= 0) & (litres > 0) & (minutes > 0) & (mean_depth_m >= 0)
    return F.when(sound, (start_bar - end_bar) * litres / minutes / (1 + mean_depth_m / 10.0))


def shown(c: Column, unit: str, places: int = 1) -> Column:
    """A number with its unit for a reader, and a dash for null."""
    return F.when(c.isNull(), "—").otherwise(F.format_string(f"%.{places}f {unit}", c.cast("double")))


def coordinates(lat: Column, lon: Column) -> Column:
    """Latitude and longitude with five decimals; null if one is."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.5f, %.5f", lat.cast("double"), lon.cast("double")))


def date_to_serial(day: Column, seconds: Column) -> Column:
    """The spreadsheet serial of a day and the seconds since its midnight."""
    return F.datediff(day, F.lit(SERIAL_ZERO).cast("date")) + seconds / 86_400
