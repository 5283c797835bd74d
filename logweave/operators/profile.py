"""Summaries of sampled series held as arrays, without exploding them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, key: str, series: str, interval_s: int = 15) -> DataFrame:
    """Samples, length, extremes, plain mean and the fastest rise per minute of a series sampled every interval_s.

    A null or empty series has no row here; see timed_summary() for series with times of their own.
    """
    s = F.col("series")
    n = F.size(s)
    rise = F.transform(F.slice(s, 2, F.greatest(n - 1, F.lit(0))), lambda v, i: (F.element_at(s, i + 1) - v) / interval_s * 60)
    own = df.select(key, F.transform(series, lambda v: v.cast("double")).alias("series")).where(n > 0)
    mean = F.aggregate(s, F.lit(0.0), lambda a, v: a + v) / n
    return own.select(key, n.cast("long").alias("n"), ((n - 1) * interval_s).cast("long").alias("seconds"), F.round(F.array_max(s), 5).alias("most"), F.round(F.array_min(s), 5).alias("least"), F.round(mean, 5).alias("mean"), F.round(F.greatest(F.array_max(rise), F.lit(0.0)), 4).alias("fastest_rise"))


def timed_summary(df: DataFrame, key: str, time: str | None, depth: str | None, temp: str | None = None) -> DataFrame:
    """(key, n, duration_s, max_depth_m, avg_depth_m, max_ascent_m_per_min, interval_s, min_temp_c, max_temp_c, channels) of
    every row, by the series' own times.

    n: samples of the longest channel. The mean is the plain one over samples. Ascents count between neighbours of which the
    second is later and shallower; unknown (null) with fewer than two depths or another number of times. The interval is the
    mean one, rounded. A null or empty series: n, duration and depths 0, the rest null. Null samples are passed over.
    """
    empty = F.array().cast("array<double>")
    own = {"time": time, "depth": depth, "temp": temp}
    rows = df.select(key, *[(F.col(c).cast("array<double>") if c else F.lit(None).cast("array<double>")).alias(name) for name, c in own.items()])
    rows = rows.withColumn("channels", F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), n) for n in own])), ","))
    rows = rows.withColumns({n: F.coalesce(F.col(n), empty) for n in own})
    t, d, c = F.col("time"), F.col("depth"), F.col("temp")
    span = F.coalesce(F.try_element_at(t, F.lit(-1)) - F.get(t, 0), F.lit(0.0))
    lag = lambda a, i: F.get(a, i - 1)
    rises = F.transform(d, lambda v, i: F.when((i > 0) & (F.get(t, i) > lag(t, i)) & (lag(d, i) > v), (lag(d, i) - v) / (F.get(t, i) - lag(t, i)) * 60))
    known = F.array_compact(d)
    mean = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v) / F.size(known)
    return rows.select(
        key,
        F.greatest(*[F.size(n) for n in own]).cast("long").alias("n"),
        span.alias("duration_s"),
        F.coalesce(F.array_max(d), F.lit(0.0)).alias("max_depth_m"),
        F.when(F.size(known) > 0, mean).otherwise(0.0).alias("avg_depth_m"),
        F.when((F.size(d) > 1) & (F.size(t) == F.size(d)), F.coalesce(F.array_max(rises), F.lit(0.0))).alias("max_ascent_m_per_min"),
        F.when(F.size(t) > 1, F.floor(span / (F.size(t) - 1) + 0.5).cast("long")).alias("interval_s"),
        F.array_min(c).alias("min_temp_c"),
        F.array_max(c).alias("max_temp_c"),
        "channels",
    )


def thin(df: DataFrame, key: str, series: str, points: int = 12) -> DataFrame:
    """About `points` samples at an even step, and the first, the last and the first largest one; none of an empty series."""
    n = F.size("series")
    step = F.greatest(F.lit(1), F.floor(n / points).cast("int"))
    rows = df.select(key, F.col(series).alias("series")).where(n > 0)
    top = F.array_position("series", F.array_max("series")) - 1
    flat = rows.select(key, n.alias("n"), step.alias("step"), top.alias("top"), F.posexplode("series").alias("i", "v"))
    return flat.where((F.col("i") % F.col("step") == 0) | (F.col("i") == F.col("n") - 1) | (F.col("i") == F.col("top"))).select(key, "i", F.round(F.col("v").cast("double"), 5).alias("v"))
