"""What hand-kept sheets write for dates, times and lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.text import clean_number
from logweave.functions.units import fraction_to_seconds, serial_to_date

#: Kinds of gear by the first pattern that the lower-case name has, in this order.
GEAR_KINDS = [
    ("drysuit", r"dry\s?suit"),
    ("wetsuit", r"wet\s?suit|shorty|jacket"),
    ("bcd", r"\bbcd?\b|buoyancy|wing"),
    ("regulator", r"reg(ulator)?|octo"),
    ("computer", r"computer|watch|perdix|shearwater"),
    ("fins", r"fin"),
    ("boots", r"boot"),
    ("hood", r"hood"),
    ("gloves", r"glove"),
    ("light", r"light|torch"),
    ("camera", r"camera|gopro"),
]


def seconds_of_day(cell: Column) -> Column:
    """h:mm, h:mm:ss (with am or pm) or a day fraction, as seconds since midnight; null for anything else."""
    text = F.trim(cell)
    clock = r"(?i)^(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm)?$"
    part = lambda k: F.regexp_extract(text, clock, k).try_cast("int")
    half = F.lower(F.regexp_extract(text, clock, 4))
    hour, minute, second = part(1), part(2), F.coalesce(part(3), F.lit(0))
    full = F.when(half == "", F.when(hour <= 23, hour)).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    on_clock = F.when((minute <= 59) & (second <= 59), full * 3600 + minute * 60 + second).cast("long")
    return F.when(text.rlike(clock), on_clock).otherwise(fraction_to_seconds(clean_number(text)))


def sheet_date(cell: Column) -> Column:
    """The date of a spreadsheet serial or of a text that begins yyyy-mm-dd; null for others and for days that do not exist."""
    number = clean_number(cell)
    return F.when((number > 1) & (number < 100_000), serial_to_date(number)).otherwise(F.try_to_date(F.regexp_extract(F.trim(cell), r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))


def at_second(day: Column, seconds: Column) -> Column:
    """A day's start and some seconds, as a time of no zone."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def wall_clock(text: Column) -> Column:
    """(local, offset_minutes) of an ISO date and time: what the clock showed, and the offset kept apart; null if unreadable.

    Minutes and seconds over 59 roll over; a day that does not exist is unreadable; Z is offset 0, none is null.
    """
    form = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
    part = lambda k: F.regexp_extract(F.trim(text), form, k)
    day = F.try_to_date(part(1), "yyyy-MM-dd")
    seconds = part(2).try_cast("int") * 3600 + part(3).try_cast("int") * 60 + F.coalesce(part(4).try_cast("int"), F.lit(0))
    local = at_second(day, seconds)
    zone = part(5)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(F.regexp_replace(zone, ":", ""), 4, 2).try_cast("int")
    offset = F.when(zone == "Z", 0).when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes)
    return F.when(day.isNotNull(), F.struct(local.alias("local"), offset.cast("int").alias("offset_minutes")))


def split_list(text: Column) -> Column:
    """Trimmed, non-empty parts between commas, semicolons, slashes and bars that stand outside quotes; quotes are dropped.

    Both kinds of quote open anywhere and close with their own kind, so an apostrophe opens one; an open one runs to the end.
    """
    # possessive throughout: a plain repeated group recurses once a character, and a long cell would end the stack
    part = r"""(?:[^,;/|"']++|"[^"]*+(?:"|$)|'[^']*+(?:'|$))++"""
    bare = lambda p: F.trim(F.regexp_replace(p, r"""\"([^"]*+)(?:"|$)|'([^']*+)(?:'|$)""", "$1$2"))
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(part), F.lit(0)), bare), lambda p: p != "")


def gear_kind(name: Column) -> Column:
    """The kind of a piece of gear by its name; other if no pattern fits."""
    text, kind = F.lower(name), None
    for value, pattern in GEAR_KINDS:
        kind = F.when(text.rlike(pattern), value) if kind is None else kind.when(text.rlike(pattern), value)
    return F.when(name.isNotNull(), kind.otherwise("other"))
