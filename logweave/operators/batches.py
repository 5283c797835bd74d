"""Imports one after the other: each batch is matched against what the batches before it made, and merged into it.

A table of sources holds what every batch said; records are resolved from all their sources at once. Between batches both
are written to the shared folder, so that a batch reads tables and not the plans of all batches before it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators import linking, merging
from logweave.sources.shared import written

#: The field path of each column of an observation.
PATHS = {
    "start_local": "startTimeLocal",
    "start_utc": "startTimeUtc",
    "offset_minutes": "tzOffsetMinutes",
    "duration_s": "durationS",
    "max_depth_m": "maxDepthM",
    "avg_depth_m": "avgDepthM",
    "site_name": "site.name",
    "lat": "site.lat",
    "lon": "site.lon",
    "gas": "gases",
    "water_temp_c": "waterTempMinC",
    "air_temp_c": "airTempC",
    "visibility_m": "visibilityM",
    "weight_kg": "weightKg",
    "water_type": "waterType",
    "rating": "rating",
    "dive_number": "diveNumber",
}
#: Rows of a batch at the most: a record's id is the batch's place times this, plus the row that made it.
ROWS = 1 << 40


class History(NamedTuple):
    """sources (owner, record, batch, row, kind, source_ref, recorded_at, fields), records (owner, record, fields, n_sources,
    source_refs) resolved from them, and decisions (owner, batch, row, decision, record, score) of all rows."""

    sources: DataFrame
    records: DataFrame
    decisions: DataFrame


def resolved_wide(sources: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(owner, record, fields..., n_sources, source_refs): of each field the value of the best source that has one.

    Best is the least merging.rank() of the field for the source's kind, then the latest recorded_at, then the least (batch,
    row). All fields are resolved in one aggregation, each with its own type.
    """
    late = -F.unix_micros(F.col("recorded_at").cast("timestamp"))
    ranks = {c: merging.rank(F.lit(path), F.col("kind")) for c, path in fields.items()}
    ranked = sources.withColumns({f"_{c}": F.when(F.col(c).isNotNull(), F.struct(r.alias("rank"), late.alias("late"), "batch", "row")) for c, r in ranks.items()})
    won = [F.min_by(c, f"_{c}").alias(c) for c in fields]
    return ranked.groupBy("owner", "record").agg(*won, F.count(F.lit(1)).alias("n_sources"), F.array_sort(F.collect_set("source_ref")).alias("source_refs"))


def _sides(observed: DataFrame, records: DataFrame) -> DataFrame:
    names = {"start_local": "at", "start_utc": "utc", "max_depth_m": "depth", "duration_s": "seconds", "site_name": "site"}
    there = lambda df: df.withColumnsRenamed({c: n for c, n in names.items() if c in df.columns})
    full = lambda df: df.withColumns({c: F.lit(None).cast(kind) for c, kind in (("at", "timestamp"), ("depth", "double"), ("seconds", "double")) if c not in df.columns})
    o = full(there(observed)).withColumnRenamed("row", "id")
    r = full(there(records)).withColumnRenamed("record", "id")
    return linking.scored(linking.candidates(o, r), sentences=False)


def run(batches: list[tuple[str, DataFrame]], fields: dict[str, str] = PATHS) -> History:
    """What batches (kind of source, observations), taken in their order, make of an empty logbook.

    observations: (owner, row, source_ref), optionally suspect, and those columns of `fields` that the source has; row is
    unique in its batch. A row merges into a record of an earlier batch as linking.decide() has it; rows of one batch do not
    see each other, and rows of a null owner no record. Any other row makes a record, an ambiguous one too, which also stays
    `ambiguous` for review.
    """
    if not batches:
        raise ValueError("at least one batch is needed")
    own = {c: p for c, p in fields.items() if any(c in df.columns for _, df in batches)}
    kinds = {c: dict(df.dtypes)[c] for _, df in reversed(batches) for c in own if c in df.columns}
    sources = records = decisions = None
    for at, (kind, observed) in enumerate(batches):
        fixed = {c: F.lit(None).cast(kinds[c]) for c in own if c not in observed.columns} | {"suspect": F.coalesce(F.col("suspect"), F.lit(False)) if "suspect" in observed.columns else F.lit(False)}
        rows = observed.withColumns(fixed).select("owner", "row", "source_ref", "suspect", *[F.col(c).cast(kinds[c]).alias(c) for c in own])
        if records is None:
            told = rows.select("*", F.lit("create").alias("decision"), F.lit(None).cast("long").alias("rec_id"), F.lit(None).cast("double").alias("score"))
        else:
            best = linking.decide(_sides(rows, records)).withColumnRenamed("obs_id", "row").drop("owner")
            told = rows.join(best, "row", "left").withColumn("decision", F.coalesce("decision", F.lit("create")))
        made = F.lit(at * ROWS) + F.col("row")
        told = told.select("owner", F.lit(at).alias("batch"), "row", "decision", F.when(F.col("decision") == "merge", F.col("rec_id")).otherwise(made).alias("record"), "score", "source_ref", *own)
        # a row goes with its own decision from here on and is not looked up by its number again
        taken = written(told)
        told = taken.select("owner", "batch", "row", "decision", "record", "score")
        decisions = told if decisions is None else decisions.unionByName(told)
        times = [F.col(c).cast("timestamp") for c in ("start_utc", "start_local") if c in own]
        recorded = F.coalesce(*times, F.timestamp_seconds(F.lit(0)))
        new = taken.select("owner", "record", "batch", "row", F.lit(kind).alias("kind"), "source_ref", recorded.alias("recorded_at"), *own)
        sources = new if sources is None else sources.unionByName(new)
        records = written(resolved_wide(sources, own))
    return History(sources, records, decisions)
