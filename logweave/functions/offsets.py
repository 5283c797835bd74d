"""Zone offsets: those that were written as hours in the minutes' place, and the third of (utc, local, offset)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suspect(minutes: Column) -> Column:
    """Less than an hour and not a whole number of hours: no real zone. False for null."""
    return F.coalesce((F.abs(minutes) < 60) & (minutes % 60 != 0), F.lit(False))


def repaired(minutes: Column, derived: Column) -> Column:
    """(offset, suspect, confidence): the hours that were meant where the place's own offset (derived) confirms them.

    A sound or missing offset stays, with null confidence; an unconfirmed one stays and is still suspect.
    """
    wrong = suspect(minutes)
    confirmed = wrong & F.coalesce(derived == minutes * 60, F.lit(False))
    return F.struct(
        F.when(confirmed, minutes * 60).otherwise(minutes).alias("offset"),
        (wrong & ~confirmed).alias("suspect"),
        F.when(confirmed, "high").when(wrong, "low").alias("confidence"),
    )


def formatted(minutes: Column) -> Column:
    """-240 as -04:00."""
    size = F.abs(minutes)
    return F.when(minutes.isNotNull(), F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60).cast("int"), (size % 60).cast("int")))


def completed(utc: Column, local: Column, minutes: Column) -> Column:
    """(utc, local, minutes), times in seconds since 1970 by their own clock; any two give the third."""
    return F.struct(
        F.coalesce(utc, local - minutes * 60).alias("utc"),
        F.coalesce(local, utc + minutes * 60).alias("local"),
        F.coalesce(minutes, F.floor((local - utc) / 60 + 0.5).cast("int")).alias("minutes"),
    )
