"""Values as a reader sees them: in the units of their choice, at the precision these are shown with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions import units

MISSING = "—"


@dataclass(frozen=True)
class Units:
    """A reader's choice: a system, and single units that differ from it (ft or m, F or C, lb or kg, psi or bar)."""

    system: str = "metric"
    depth: str | None = None
    temperature: str | None = None
    weight: str | None = None
    pressure: str | None = None

    def uses(self, kind: str, imperial: str) -> bool:
        own = getattr(self, kind)
        return own == imperial if own else self.system == "imperial"


METRIC = Units()


def _text(c: Column, unit: str, places: int) -> Column:
    return F.when(c.isNull() | F.isnan(c), MISSING).otherwise(F.format_string(f"%.{places}f {unit}", c))


def depth(metres: Column, prefs: Units = METRIC) -> Column:
    """Metres with one decimal, or whole feet."""
    c = metres.cast("double")
    return _text(c / units.METRES_PER_FOOT, "ft", 0) if prefs.uses("depth", "ft") else _text(c, "m", 1)


def temperature(celsius: Column, prefs: Units = METRIC) -> Column:
    """Degrees Celsius with one decimal, or whole degrees Fahrenheit."""
    c = celsius.cast("double")
    return _text(c * 9 / 5 + 32, "°F", 0) if prefs.uses("temperature", "F") else _text(c, "°C", 1)


def weight(kilograms: Column, prefs: Units = METRIC) -> Column:
    """Kilograms with one decimal, or whole pounds."""
    c = kilograms.cast("double")
    return _text(c / units.KILOGRAMS_PER_POUND, "lb", 0) if prefs.uses("weight", "lb") else _text(c, "kg", 1)


def pressure(bar: Column, prefs: Units = METRIC) -> Column:
    c = bar.cast("double")
    return _text(c * units.PASCALS_PER_BAR / units.PASCALS_PER_PSI, "psi", 0) if prefs.uses("pressure", "psi") else _text(c, "bar", 0)


def duration(seconds: Column) -> Column:
    """Whole minutes, halves up, in any system."""
    return _text(F.floor(seconds.cast("double") / 60 + 0.5).cast("double"), "min", 0)


#: What the values of a field path are measured in.
KINDS = {
    "maxDepthM": depth,
    "avgDepthM": depth,
    "visibilityM": depth,
    "waterTempMinC": temperature,
    "airTempC": temperature,
    "weightKg": weight,
}


def field_value(path: Column, value: Column, prefs: Units = METRIC) -> Column:
    """The text that is shown for a field's value, given as text: measures in the reader's units, times to the minute, other
    numbers with four decimals at the most, anything else as it is."""
    number = value.try_cast("double")
    plain = F.regexp_replace(F.format_string("%.4f", number), r"\.?0++$", "")
    stamp = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    shown = F.when(value.isNull(), MISSING).when(stamp, F.substring(F.replace(value, F.lit("T"), F.lit(" ")), 1, 16))
    for name, as_shown in KINDS.items():
        shown = shown.when((path == name) & number.isNotNull(), as_shown(number, prefs))
    shown = shown.when((path == "durationS") & number.isNotNull(), duration(number))
    return shown.when(number.isNotNull(), plain).otherwise(value)
