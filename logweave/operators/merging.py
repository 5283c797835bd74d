"""Merging by precedence with provenance, union fields, notes, number claims and reverts by recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators import running

#: Where a kind of source comes from; others are imports of files.
ORIGINS = {"uddf": "instrument", "api:garmin": "instrument", "shearwater": "instrument", "manual": "manual", "spreadsheet": "file_import", "subsurface": "file_import", "csv": "file_import", "derived": "derived"}
#: The class of each field path; others are measured.
CLASSES = {
    "measured": ["startTimeLocal", "startTimeUtc", "tzOffsetMinutes", "maxDepthM", "avgDepthM", "durationS", "waterTempMinC", "airTempC", "profile"],
    "subjective": ["notes", "rating", "visibilityM", "buddies", "waterType"],
    "identifying": ["site.name", "site.regionHint", "diveNumber", "tags"],
    "configured": ["gases", "tanks", "weightKg", "gear"],
    "geographic": ["site.lat", "site.lon", "site.altitudeM"],
}
#: Origins by preference, best first, for each class of field.
PREFERENCES = {
    "measured": ["instrument", "manual", "file_import", "derived"],
    "geographic": ["instrument", "manual", "file_import", "derived"],
    "subjective": ["manual", "file_import", "instrument", "derived"],
    "identifying": ["manual", "file_import", "instrument", "derived"],
    "configured": ["manual", "file_import", "instrument", "derived"],
}
#: Fields that an instrument's file measures itself, by kind of source.
SENSED = {"uddf": ["gases", "profile", "waterTempMinC"]}


def _looked_up(found: dict[str, object], key: Column) -> Column:
    """The entry of a constant map, null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in found.items() for x in pair]), key)


def origin(kind: Column) -> Column:
    """Where a kind of source comes from; an unknown or null kind is an imported file."""
    return F.coalesce(F.when(kind.isNotNull(), _looked_up(ORIGINS, kind)), F.lit("file_import"))


def field_class(field: Column) -> Column:
    return F.coalesce(_looked_up({f: name for name, fields in CLASSES.items() for f in fields}, field), F.lit("measured"))


def rank(field: Column, kind: Column, sensed: Column | None = None) -> Column:
    """The place of a source's kind in the preference for a field, 0 the best; what an instrument sensed of a configured
    field goes before all (-1). sensed: whether it did; without it, by the kind's own list."""
    places = {f"{name}|{value}": place for name, order in PREFERENCES.items() for place, value in enumerate(order)}
    found = _looked_up(places, F.concat_ws("|", field_class(field), origin(kind)))
    if sensed is None:
        # all that is sensed and configured, by kinds that are instruments
        own = [(k, f) for k, fields in SENSED.items() for f in fields if ORIGINS.get(k) == "instrument" and f in CLASSES["configured"]]
        first = F.lit(False)
        for k, f in own:
            first = first | ((kind == k) & (field == f))
    else:
        first = sensed & (field_class(field) == "configured") & (origin(kind) == "instrument")
    return F.when(F.coalesce(first, F.lit(False)), -1).otherwise(found)


def _differs(df: DataFrame, tolerance: float) -> Column:
    numeric = dict(df.dtypes)["value"] in ("double", "float", "int", "bigint", "smallint", "tinyint") or dict(df.dtypes)["value"].startswith("decimal")
    low, high, value = F.col("w.low"), F.col("w.high"), F.col("w.value")
    return F.greatest(high - value, value - low) > tolerance if numeric else (low != value) | (high != value)


def resolve(assertions: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """The winner of each (record, field) among rows (record, field, value, rank, recorded_at, source).

    Nulls do not take part. The best rank wins, then the latest, then the least source; contested says that a row of the
    winner's rank differs, numbers by more than the tolerance. Values are of any type that has an order: texts, dates,
    arrays and structs are compared whole. One exchange by (record, field) serves both aggregations.
    """
    late = (-F.unix_micros(F.col("recorded_at").cast("timestamp"))).alias("late")
    there = assertions.where("value is not null").select("record", "field", "rank", "value", "source", late).repartition("record", "field")
    ranked = there.groupBy("record", "field", "rank").agg(F.min(F.struct("late", "source", "value")).alias("b"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    won = ranked.groupBy("record", "field").agg(F.min(F.struct("rank", "b.late", "b.source", "b.value", "low", "high")).alias("w"), F.sum("n").alias("n_sources"))
    return won.select("record", "field", F.col("w.value").alias("value"), F.col("w.source").alias("source"), "n_sources", _differs(assertions, tolerance).alias("contested"))


#: Fields to which sources add instead of contradicting one another.
ADDED = ["tags", "buddies", "notes"]


def provenance(assertions: DataFrame, added: list[str] = ADDED) -> DataFrame:
    """Each non-null assertion with is_selected: whether its source won its (record, field), or adds to it (fields `added`)."""
    best = F.struct("rank", (-F.unix_micros(F.col("recorded_at").cast("timestamp"))).alias("late"), "source", "value")
    there = assertions.where("value is not null")
    # the winner is a minimum by field, joined back; a field that many sources assert is not sorted in one task
    won = there.groupBy(F.col("record").alias("_record"), F.col("field").alias("_field")).agg(F.min(best)["source"].alias("_first"))
    marked = there.join(won, F.col("record").eqNullSafe(F.col("_record")) & F.col("field").eqNullSafe(F.col("_field")))
    return marked.withColumn("is_selected", F.col("field").isin(added) | (F.col("source") == F.col("_first"))).drop("_record", "_field", "_first")


def conflicts(assertions: DataFrame) -> DataFrame:
    """(record, field, n, distinct_values) of fields that several assertions give; several values: a disagreement."""
    there = assertions.where("value is not null").groupBy("record", "field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("value").cast("string")).alias("distinct_values"))
    return there.where("n > 1")


def shown_conflicts(assertions: DataFrame, shown: Column) -> DataFrame:
    """(record, field, shown): fields whose assertions are shown as different texts, with these texts in order.

    shown: what a reader sees for a row's value (see functions.display.field_value()); values that look alike to this
    reader do not disagree for them. Nulls do not take part.
    """
    texts = assertions.where("value is not null").select("record", "field", shown.alias("shown")).distinct()
    return texts.groupBy("record", "field").agg(F.array_sort(F.collect_set("shown")).alias("shown")).where(F.size("shown") > 1)


def contested_fields(resolved: DataFrame) -> DataFrame:
    """(record, contested): the sorted paths of each record's contested fields, comma-separated, empty if there are none."""
    paths = F.collect_set(F.when(F.col("contested"), F.col("field")))
    return resolved.groupBy("record").agg(F.array_join(F.array_sort(paths), ",").alias("contested"))


def union_values(rows: DataFrame, record: str, order: str, value: str) -> DataFrame:
    """Distinct values by trimmed lower-case form, the first spelling of each, in order of first use."""
    first = rows.where(F.trim(value) != "").groupBy(record, F.lower(F.trim(value)).alias("form")).agg(F.min(F.struct(F.col(order).alias("o"), F.trim(value).alias("v"))).alias("s"))
    merged = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]), ",")
    return first.groupBy(record).agg(merged.alias("merged"), F.count(F.lit(1)).alias("n"))


def append_notes(rows: DataFrame, record: str, order: str, kind: str, text: str) -> DataFrame:
    """(record, notes, n): each record's different notes, trimmed, oldest first, apart by an empty line.

    Where a record has several notes (equal ones counted), each is followed by a line that names its source's kind. Null
    and empty notes do not take part; of equal notes the oldest stays.
    """
    own = rows.where(F.col(text).isNotNull()).select(record, F.col(order).alias("o"), F.col(kind).alias("k"), F.trim(text).alias("t"))
    each = own.groupBy(record, "t").agg(F.min(F.struct("o", "k")).alias("s"), F.count(F.lit(1)).alias("times"))
    told = each.groupBy(record).agg(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("s.o", "s.k", "t")))).alias("parts"), F.sum("times").alias("all"))
    written = F.transform("parts", lambda p: F.when(F.col("all") > 1, F.concat(p["t"], F.lit("\n\n— "), p["k"])).otherwise(p["t"]))
    return told.where(F.size("parts") > 0).select(record, F.array_join(written, "\n\n").alias("notes"), F.size("parts").cast("long").alias("n"))


def claim_numbers(rows: DataFrame, owner: str, when: str, key: str, wanted: str, held: DataFrame | None = None, most: int = running.MOST) -> DataFrame:
    """Numbers for rows: the first claimant of a wanted number (1 or more) that the logbook does not hold keeps it, all
    others follow the owner's largest number, held or kept, in order of time. held: (owner, number) of the logbook.

    First claimants are a minimum by owner and number, so that no window gathers all who want the same one; the others are
    numbered in ranges where an owner has more than `most` rows.
    """
    own, place = F.col(owner), F.struct(when, key)
    rows = rows.withColumn(wanted, F.col(wanted).cast("long"))
    first = rows.where(F.col(wanted) >= 1).groupBy(own.alias("_owner"), F.col(wanted).alias("_wanted")).agg(F.min(place).alias("_first"))
    if held is not None:
        taken = held.select(F.col(held.columns[0]).alias("_owner"), F.col(held.columns[1]).cast("long").alias("_wanted")).where("_wanted is not null")
        once = taken.distinct().alias("t")
        first = first.alias("f").join(once, F.expr("f._owner <=> t._owner and f._wanted = t._wanted"), "left_anti")
        tops = first.select("_owner", "_wanted").unionByName(taken)
    else:
        tops = first.select("_owner", "_wanted")
    tops = tops.groupBy(F.col("_owner").alias("_whose")).agg(F.max("_wanted").alias("_top"))
    kept = rows.join(first, own.eqNullSafe(F.col("_owner")) & (F.col(wanted) == F.col("_wanted")), "left")
    kept = kept.withColumn("number", F.when(F.col("_first") == place, F.col(wanted))).drop("_owner", "_wanted", "_first")
    kept = kept.join(tops, own.eqNullSafe(F.col("_whose")), "left").drop("_whose")
    after = running.Ordered(kept, owner, [when, key], most).add(_after=running.count(F.col("number").isNull())).rows()
    return after.withColumn("number", F.coalesce(F.col("number"), F.coalesce("_top", F.lit(0)) + F.col("_after"))).drop("_top", "_after")


#: Reverted sources that are broadcast at the most; with more of them the assertions are joined by source.
BROADCAST_SOURCES = 100_000


def revert(assertions: DataFrame, sources: DataFrame) -> DataFrame:
    """What the records are without some sources (column source): those left without any row are gone."""
    gone = sources.select("source").distinct()
    side = F.broadcast(gone) if gone.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else gone
    return resolve(assertions.join(side, "source", "left_anti"))


def orphans(assertions: DataFrame, sources: DataFrame) -> DataFrame:
    """(record, deleted): the records that a revert of these sources touches, and whether it leaves them without a source."""
    marked = assertions.join(sources.select("source").distinct().withColumn("gone", F.lit(True)), "source", "left")
    return marked.groupBy("record").agg(F.count_if(F.col("gone").isNotNull()).alias("n_gone"), F.count(F.lit(1)).alias("n")).where("n_gone > 0").select("record", (F.col("n_gone") == F.col("n")).alias("deleted"))


def recorded_at(utc: Column, local: Column, now: Column) -> Column:
    """When a source recorded what it says: its universal time, else its wall clock, else now."""
    return F.coalesce(utc, local, now)


def profiles(resolved: DataFrame, blobs: DataFrame, field: str = "profile") -> DataFrame:
    """(record, source, blob) of records whose `field` some source still asserts: the winning source's own blob.

    resolved: see resolve(); blobs: (record, source, blob). A record that no source gives a profile has no row.
    """
    won = resolved.where(F.col("field") == field).select("record", "source")
    return won.join(blobs.groupBy("record", "source").agg(F.min("blob").alias("blob")), ["record", "source"])
