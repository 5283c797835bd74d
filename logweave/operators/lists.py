"""Lists and counters beside a logbook: totals of related rows, health of imports, review sheets and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def related(parents: DataFrame, children: DataFrame, key: str, amounts: dict[str, Column] | None = None) -> DataFrame:
    """Parents, all columns, with n (their children, 0 if none) and further aggregates of them; children without a parent drop out."""
    counted = children.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(name) for name, c in (amounts or {}).items()])
    return parents.join(counted, key, "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n")


def next_number(df: DataFrame, owner: str, number: str) -> DataFrame:
    """(owner, largest, next): the largest number in use, nulls and deleted rows left out by the caller, and the one after it."""
    return df.groupBy(owner).agg(F.max(number).alias("largest")).select(owner, "largest", (F.coalesce(F.col("largest"), F.lit(0)) + 1).cast("long").alias("next"))


def import_stats(rows: DataFrame, batch: str, decision: str, kinds: list[str], arrays: list[str] | None = None) -> DataFrame:
    """(batch, n, one column for each decision, one for each of `arrays`): how many rows of a batch were decided how, and how
    many entries their arrays (issues, say) have in all; a null array has none."""
    sizes = [F.sum(F.greatest(F.size(a), F.lit(0))).cast("long").alias(a) for a in arrays or []]
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(decision) == k).alias(k) for k in kinds], *sizes)


def page_totals(dives: DataFrame, of: str, depth: str, seconds: str, day: str) -> DataFrame:
    """(of, n, deepest, bottom_time_s, first_day) of a site's or a trip's dives: null depths are left out, a null time counts
    as none; dives of no site or trip have no row."""
    there = dives.where(F.col(of).isNotNull())
    return there.groupBy(of).agg(F.count(F.lit(1)).alias("n"), F.max(depth).alias("deepest"), F.coalesce(F.sum(seconds), F.lit(0)).cast("long").alias("bottom_time_s"), F.min(day).alias("first_day"))


def health(batches: DataFrame, kind: str, state: str, rows: str, failed: str = "failed", committed: str = "committed") -> DataFrame:
    """(kind, batches, failed, committed, rows, failure_pct): the share of failed batches, rounded to a whole percent."""
    got = batches.groupBy(kind).agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.col(state) == failed).alias("failed"), F.count_if(F.col(state) == committed).alias("committed"), F.coalesce(F.sum(rows), F.lit(0)).alias("rows"))
    return got.withColumn("failure_pct", F.floor(100 * F.col("failed") / F.col("batches") + 0.5).cast("long"))


def from_several(df: DataFrame, record: str, source: str) -> DataFrame:
    """(record, n) of records that more than one source asserts."""
    return df.groupBy(record).agg(F.count_distinct(source).alias("n")).where("n > 1")


def proposals(matched: DataFrame, tags: DataFrame, column: str) -> DataFrame:
    """(slug, label, kind, occurrences): one proposal for each slug that tags match (taxonomy.match), with all rows behind it;
    the label and kind are those of the least input."""
    counted = tags.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("input")).agg(F.count(F.lit(1)).alias("c"))
    return matched.join(counted, "input").groupBy("slug").agg(F.min_by(F.struct("label", "kind"), "input").alias("b"), F.sum("c").alias("occurrences")).select("slug", "b.label", "b.kind", "occurrences")


def extent(places: DataFrame, by: list[str], lat: str = "lat", lon: str = "lon", least: float = 0.045, room: float = 1.25) -> DataFrame:
    """(by..., n, centre and span of both axes) of places with coordinates; a span is at least `least` degrees, times `room`."""
    there = places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    ends = there.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{side}_{name}") for name, c in (("lat", lat), ("lon", lon)) for side, f in (("low", F.min), ("high", F.max))])
    axis = lambda name: ((F.col(f"low_{name}") + F.col(f"high_{name}")) / 2, F.greatest(F.col(f"high_{name}") - F.col(f"low_{name}"), F.lit(least)) * room)
    (a, da), (b, db) = axis("lat"), axis("lon")
    return ends.select(*by, "n", a.alias("centre_lat"), b.alias("centre_lon"), da.alias("span_lat"), db.alias("span_lon"))


def plotted(lat: Column, lon: Column, centre: tuple[Column, Column], span: tuple[Column, Column], width: float, height: float) -> Column:
    """(x, y) of a place on a plot of an extent, equirectangular, north up, to one decimal (halves go up)."""
    tenth = lambda v: F.floor(v * 10 + 0.5) / 10
    return F.struct(tenth(((lon - centre[1]) / span[1] + 0.5) * width).alias("x"), tenth((0.5 - (lat - centre[0]) / span[0]) * height).alias("y"))


def marked(sites: DataFrame, count: str) -> DataFrame:
    """sites with radius: markers whose area goes with the count, 5 for none to 14 for the largest. One row is broadcast."""
    top = sites.agg(F.max(count).alias("_top"))
    return sites.crossJoin(F.broadcast(top)).withColumn("radius", F.when(F.coalesce("_top", F.lit(0)) > 0, 5 + 9 * F.sqrt(F.coalesce(count, F.lit(0)) / F.col("_top"))).otherwise(5.0)).drop("_top")


def review(rows: DataFrame, decision: str, reasons: str, issues: str) -> DataFrame:
    """(decision, reasons, n, with_problems): rows with the same decision for the same reasons, and how many of them have an
    issue that is more than information."""
    worse = F.exists(issues, lambda i: i["severity"] != "info")
    return rows.groupBy(decision, F.array_join(reasons, "; ").alias("reasons")).agg(F.count(F.lit(1)).alias("n"), F.count_if(worse).alias("with_problems"))


def site_totals(dives: DataFrame, owner: str, site: str) -> DataFrame:
    """(owner, n, sites, unlocated): an owner's dives, the different sites among them, and dives without a site."""
    return dives.groupBy(owner).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(site).alias("sites"), F.count_if(F.col(site).isNull()).alias("unlocated"))
