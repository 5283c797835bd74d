"""Logbook analytics: totals, gap-filled calendars, histograms, numbering, intervals, streaks and trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators import running


def totals(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Count, sum (0 if none), maximum and mean of an amount; nulls are ignored."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.sum(amount), F.lit(0.0)), 2).alias("total"),
        F.max(amount).alias("largest"),
        F.round(F.avg(amount), 4).alias("mean"),
    )


def by_period(df: DataFrame, period: Column, amount: str, name: str, fixed: tuple[int, int] | None = None) -> DataFrame:
    """Count and sum for each period from the first to the last (or of a fixed range), empty ones included."""
    got = df.groupBy(period.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum(amount), F.lit(0.0)), 2).alias("total")).where(F.col(name).isNotNull())
    ends = (F.lit(fixed[0]), F.lit(fixed[1])) if fixed else (F.min(name), F.max(name))
    # one row of ends, grown to as many rows as there are periods
    source = got.agg(F.first(F.lit(1)).alias("one"), ends[0].alias("a"), ends[1].alias("b")) if fixed else got.agg(ends[0].alias("a"), ends[1].alias("b"))
    every = source.where("a is not null").select(F.explode(F.sequence("a", "b")).alias(name))
    return every.join(got, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def histogram(df: DataFrame, amount: str, width: float) -> DataFrame:
    """Rows in each bucket of a width from 0 to the last one used, empty buckets kept; nulls and negatives are left out."""
    got = df.where(F.col(amount) >= 0).groupBy(F.floor(F.col(amount) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = got.agg(F.max("bucket").alias("b")).where("b is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "b")).alias("bucket"))
    return every.join(got, "bucket", "left").select("bucket", (F.col("bucket") * width).alias("from_value"), F.coalesce("n", F.lit(0)).alias("n"))


def numbering(df: DataFrame, owner: str, when: str, key: str, start: int = 1, most: int = running.MOST) -> DataFrame:
    """Numbers in order of time, ties by key; rows without a time come first, a null owner is an owner.

    Owners with more than `most` rows are numbered in ranges (see running.Ordered).
    """
    if start < 0:
        raise ValueError(f"numbers start at 0 or above, not at {start}")
    rows = running.Ordered(df, owner, [when, key], most).add(number=running.count()).rows()
    return rows.withColumn("number", F.col("number") + F.lit(start - 1))


def changed(df: DataFrame, number: str, before: Column) -> DataFrame:
    """The rows whose number is another one than before (null counts as another one)."""
    return df.where(~F.col(number).eqNullSafe(before))


def intervals(df: DataFrame, owner: str, when: str, key: str, seconds: str, offset: Column | None = None, most: int = running.MOST) -> DataFrame:
    """Adds interval_s, from the end of the row before to this one (null where unknown or negative), and the number in a
    run of one day: a day that comes back later starts again at 1.

    offset: minutes by which each row's own day is off that of `when` (null: none). Rows without a time come first and
    count as one day. Owners with more than `most` rows are worked out in ranges.
    """
    start = F.unix_micros(F.col(when).cast("timestamp")) / 1e6
    shift = F.lit(0) if offset is None else F.coalesce(offset, F.lit(0))
    day = F.to_date(F.timestamp_micros(F.unix_micros(F.col(when).cast("timestamp")) + shift.cast("long") * 60_000_000))
    rows = running.Ordered(df.withColumn("_now", F.struct(start.alias("start"), (start + F.col(seconds)).alias("end"), day.alias("day"))), owner, [when, key], most)
    rows.add(_before=running.last(F.col("_now"), False), _number=running.count())
    same = F.col("_before").isNotNull() & F.col("_now.day").eqNullSafe(F.col("_before.day"))
    rows.map(lambda df: df.withColumn("_fresh", F.when(~same, F.col("_number")))).add(_since=running.largest(F.col("_fresh")))
    gap = F.round(F.col("_now.start") - F.col("_before.end"))
    found = rows.rows().withColumn("interval_s", F.when(gap >= 0, gap).cast("long")).withColumn("repetition", F.col("_number") - F.col("_since") + 1)
    return found.drop("_now", "_before", "_number", "_fresh", "_since")


def streaks(df: DataFrame, owner: str, when: str) -> DataFrame:
    """The longest run of days in a row of each owner, the earliest of equal ones.

    Days are made distinct before they are shuffled, so an owner brings as many rows to a window as the calendar has days,
    however many rows there were.
    """
    days = df.select(owner, F.to_date(when).alias("day")).where("day is not null").distinct()
    w = Window.partitionBy(owner).orderBy("day")
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(w))).groupBy(owner, "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"))
    best = F.max_by(F.struct("first_day", "last_day", "days"), F.struct("days", -F.unix_date("first_day")))
    return runs.groupBy(owner).agg(best.alias("s")).select(owner, "s.first_day", "s.last_day", "s.days")


def trips(df: DataFrame, owner: str, when: str, gap_days: int = 3, least: int = 3) -> DataFrame:
    """Sessions of at least `least` rows with no gap above gap_days days between neighbours.

    Rows are counted by day before they are shuffled: an owner has as many rows there as the calendar has days.
    """
    daily = df.groupBy(owner, F.to_date(when).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(owner).orderBy("day")
    split = F.when(F.datediff("day", F.lag("day").over(w)) <= gap_days, 0).otherwise(1)
    return (
        daily.where("day is not null").withColumn("split", split).withColumn("trip", F.sum("split").over(w))
        .groupBy(owner, "trip").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("n"))
        .where(F.col("n") >= least).drop("trip")
    )


def named_trips(found: DataFrame, where: Column) -> DataFrame:
    """Adds to trips() a name (where, month and year of the first day) and a key (first day and size)."""
    name = F.concat(where, F.lit(", "), F.date_format("first_day", "MMMM yyyy"))
    return found.withColumn("name", name).withColumn("key", F.concat(F.date_format("first_day", "yyyy-MM-dd"), F.lit("_"), F.col("n").cast("string")))


def mode(df: DataFrame, owner: str, value: str) -> DataFrame:
    """The most frequent value, ties to the first in the alphabet; null and empty values are skipped."""
    counts = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(owner, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("common")))
    return counts.groupBy(owner).agg(best.alias("b")).select(owner, "b.common", (-F.col("b.less")).alias("n"))


def repeated_numbers(df: DataFrame, owner: str, number: Column) -> DataFrame:
    """(owner, number, n) of numbers that an owner has more than once; rows without a number do not count."""
    return df.groupBy(owner, number.alias("number")).agg(F.count(F.lit(1)).alias("n")).where("number is not null and n > 1")
