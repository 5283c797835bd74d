"""Spreadsheet rows as observations: header guess, units, ranges, and what was wrong with each cell."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import units
from logweave.functions.parsing import at_second, seconds_of_day, sheet_date, split_list
from logweave.functions.text import clean_number, no_null_tokens

#: Fields and the slugs of headers that feed them, the most specific first.
HEADERS = [
    ("diveNumber", r"^dive-?(number|no|num|#)?$"),
    ("date", r"^date$|^dive-date$"),
    ("timeIn", r"^time-?in$|^start-?time$|^entry-?time$"),
    ("durationDays", r"^dive-?time$|^bottom-?time$"),
    ("durationMinutes", r"^duration(-min(utes)?)?$|^dive-?time-?min(utes)?$"),
    ("maxDepthFt", r"^(max-?)?depth.*-?ft|^(max-?)?depth.*feet"),
    ("maxDepthM", r"^(max-?)?depth.*-?m$|^(max-?)?depth.*met(re|er)"),
    ("airTempF", r"^air-?temp.*f\)?$|^air-?temp.*fahrenheit"),
    ("airTempC", r"^air-?temp.*c\)?$|^air-?temp.*celsius"),
    ("waterTempF", r"^water-?temp.*f\)?$|^water-?temp.*fahrenheit"),
    ("waterTempC", r"^water-?temp.*c\)?$|^water-?temp.*celsius"),
    ("visibilityFt", r"^vis(ibility)?.*-?ft|^vis(ibility)?.*feet"),
    ("visibilityM", r"^vis(ibility)?.*-?m$|^vis(ibility)?.*met(re|er)"),
    ("region", r"^location$|^region$|^country$|^area$"),
    ("siteName", r"^dive-?site$|^site$|^site-?name$"),
    ("waterType", r"^water-?type$|^water$"),
    ("tags", r"^dive-?type$|^type$|^tags?$"),
    ("eanPercent", r"^ean-?%?$|^o2-?%?$|^nitrox-?%?$|^ean-?percent$"),
    ("gasLabel", r"^gas$|^mix$|^breathing-?gas$"),
    ("gear", r"^equipment$|^gear$"),
    ("weightLb", r"^weight.*-?lbs?\)?$|^weight.*pounds"),
    ("weightKg", r"^weight.*-?kg\)?$|^weight.*kilo"),
    ("notes", r"^notes?$|^comments?$|^remarks?$"),
    ("buddies", r"^budd(y|ies)$|^partner$"),
    ("rating", r"^rating$|^stars$"),
]
#: The least and largest believable value of a field.
RANGES = {
    "altitude_m": (-50, 6000),
    "max_depth_m": (0, 350),
    "avg_depth_m": (0, 350),
    "duration_s": (0, 86_400),
    "water_temp_c": (-2, 45),
    "air_temp_c": (-60, 60),
    "weight_kg": (0, 60),
    "visibility_m": (0, 100),
    "rating": (0, 5),
}
WATER_TYPES = ["fresh", "salt", "brackish"]
ISSUES = "array<struct<code:string,field:string,severity:string>>"


def guess(headers: list[str]) -> tuple[dict[str, str], list[str]]:
    """Which field each header of a sheet feeds, and the headers that feed none. A field is fed once, by its first header."""
    found: dict[str, str] = {}
    for header in headers:
        plain = "".join(c for c in unicodedata.normalize("NFKD", header) if not 0x300 <= ord(c) <= 0x36F).lower()
        name = re.sub("[^a-z0-9]+", "-", plain).strip("-")
        field = next((f for f, pattern in HEADERS if f not in found.values() and re.search(pattern, name)), None)
        if field:
            found[header] = field
    return found, [h for h in headers if h not in found]


def checked(df: DataFrame, fields: list[str], ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Nulls what is out of its field's range and appends an issue for it to column issues; fields without a rule pass."""
    issues, out = [], {}
    for field in fields:
        if field in ranges:
            bad = F.col(field).isNotNull() & ~F.col(field).between(*ranges[field])
            issues.append(issue(bad, "out_of_range", field, "warning"))
            out[field] = F.when(~bad, F.col(field))
    before = F.col("issues") if "issues" in df.columns else F.array().cast(ISSUES)
    return df.withColumns({"issues": F.concat(before, F.array_compact(F.array(*issues)))} | out)


def issue(bad: Column, code: str, field: str, severity: str) -> Column:
    return F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))


def observations(rows: DataFrame, mapping: dict[str, str], keep: list[str]) -> DataFrame:
    """Rows of text cells as observations; mapping: header to field (see guess), keep: columns that go along unread.

    Metric columns win over others. A missing or unreadable date is an error, an unreadable time puts the row at midnight,
    a number out of range is dropped; each is an entry of issues. Null, empty and null-token cells are absent; repeated rows
    stay repeated.
    """
    header = {field: h for h, field in mapping.items()}
    cells = rows.select(*keep, *[no_null_tokens(F.col(f"`{header[f]}`").cast("string")).alias(f) if f in header else F.lit(None).cast("string").alias(f) for f, _ in HEADERS])
    number = lambda f: clean_number(F.col(f))
    either = lambda metric, other, convert: F.coalesce(number(metric), convert(number(other)))
    day, time = sheet_date(F.col("date")), seconds_of_day(F.col("timeIn"))
    days = units.fraction_to_seconds(number("durationDays"))
    water = F.lower("waterType")
    kind = F.coalesce(*[F.when(F.startswith(water, F.lit(t)), t) for t in WATER_TYPES])
    mix = F.when(number("eanPercent").isNotNull(), number("eanPercent") / 100).when(F.lower("gasLabel") == "air", 0.21)
    found = cells.select(
        *keep,
        F.floor(number("diveNumber") + 0.5).cast("long").alias("dive_number"),
        at_second(day, F.coalesce(time, F.lit(0))).alias("start_local"),
        either("maxDepthM", "maxDepthFt", units.feet_to_metres).alias("max_depth_m"),
        F.coalesce(days, F.floor(number("durationMinutes") * 60 + 0.5).cast("long")).alias("duration_s"),
        either("airTempC", "airTempF", units.fahrenheit_to_celsius).alias("air_temp_c"),
        either("waterTempC", "waterTempF", units.fahrenheit_to_celsius).alias("water_temp_c"),
        either("visibilityM", "visibilityFt", units.feet_to_metres).alias("visibility_m"),
        either("weightKg", "weightLb", units.pounds_to_kilograms).alias("weight_kg"),
        number("rating").alias("rating"),
        F.col("siteName").alias("site_name"),
        F.col("region"),
        kind.alias("water_type"),
        split_list(F.col("tags")).alias("tags"),
        split_list(F.col("buddies")).alias("buddies"),
        mix.alias("o2"),
        F.col("gear"),
        F.col("notes"),
        F.array_compact(
            F.array(
                issue(F.col("date").isNull(), "missing_date", "start_local", "error"),
                issue(F.col("date").isNotNull() & day.isNull(), "unreadable_date", "start_local", "error"),
                issue(day.isNotNull() & F.col("timeIn").isNotNull() & time.isNull(), "unreadable_time", "start_local", "warning"),
                issue(F.col("diveNumber").isNotNull() & number("diveNumber").isNull(), "unreadable_dive_number", "dive_number", "info"),
                issue(water.isNotNull() & kind.isNull(), "unknown_water_type", "water_type", "info"),
            )
        ).alias("issues"),
    )
    return checked(found, ["max_depth_m", "duration_s", "air_temp_c", "water_temp_c", "visibility_m", "weight_kg", "rating"])


def opaque_name(name: Column, key: Column) -> Column:
    """A site's name, or null where it is only its id or a generated one (site_ and eight or more hexadecimal digits)."""
    return F.when(~(name.eqNullSafe(key) | name.rlike("(?i)^site[_-][0-9a-f]{8,}$")), name)


def no_sentinel(df: DataFrame, column: str, sentinel: float) -> DataFrame:
    """Nulls a value that a format writes for `not set` and notes it as information in column issues."""
    hit = F.coalesce(F.col(column) == sentinel, F.lit(False))
    before = F.col("issues") if "issues" in df.columns else F.array().cast(ISSUES)
    return df.withColumns({"issues": F.concat(before, F.array_compact(F.array(issue(hit, "sentinel", column, "info")))), column: F.when(~hit, F.col(column))})


def flattened(df: DataFrame, key: list[str], fields: dict[str, str]) -> DataFrame:
    """Wide rows as (key..., field, value) for the values that are there, as text; fields: column to field path."""
    pairs = F.array(*[F.struct(F.lit(path).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c, path in fields.items()])
    return df.select(*key, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select(*key, "p.field", "p.value")


def widened(rows: DataFrame, key: list[str], fields: dict[str, str]) -> DataFrame:
    """(key..., field, value) rows back to one wide row for each key; fields: column to field path. Of several the least."""
    return rows.groupBy(*key).agg(*[F.min(F.when(F.col("field") == path, F.col("value"))).alias(c) for c, path in fields.items()])
