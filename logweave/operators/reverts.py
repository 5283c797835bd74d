"""Taking an import back: records anew from the sources that are left, to the last column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.batches import resolved_wide
from logweave.sources.shared import written

#: Columns that keep what they had if no source that is left asserts them, and what others fall back to.
KEPT = ["start_utc", "start_local"]
DEFAULTS = {"offset_minutes": 0}


def completed_times(local: Column, utc: Column, minutes: Column) -> tuple[Column, Column]:
    """(local, utc): a missing universal time is the local one less the offset, or the local one itself where no offset is
    known; a missing local time follows from the other only with an offset."""
    shift = F.make_dt_interval(mins=minutes)
    return F.coalesce(local, utc + shift), F.coalesce(utc, local - shift, local)


def reverted(records: DataFrame, sources: DataFrame, gone: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(owner, record, outcome, fields...) of every record that a revert of these batches touches.

    sources: (owner, record, batch, row, kind, source_ref, recorded_at, fields...); gone: (batch). A record none of whose
    sources is left is deleted, with null fields. Any other is resolved from those left: every field is written, a field that
    nothing asserts any more becomes null or its default, start times are completed and stay as they were where nothing
    tells them. records: (owner, record, start_utc, start_local), as they were.
    """
    # written, so that the joins know how few they are and do not deal all sources by their few batches
    ids = written(gone.select("batch").distinct())
    touched = sources.join(ids, "batch", "left_semi").select("owner", "record").distinct()
    left = sources.join(ids, "batch", "left_anti").join(touched, ["owner", "record"], "left_semi")
    anew = resolved_wide(left, fields).select("owner", "record", *fields, F.lit(True).alias("_there"))
    before = records.select("owner", "record", *[F.col(c).alias(f"_{c}") for c in KEPT if c in fields])
    rows = touched.join(anew, ["owner", "record"], "left").join(before, ["owner", "record"], "left")
    there = F.coalesce("_there", F.lit(False))
    local, utc = (F.col(c) if c in fields else F.lit(None).cast("timestamp") for c in ("start_local", "start_utc"))
    minutes = F.col("offset_minutes") if "offset_minutes" in fields else F.lit(None).cast("int")
    full = dict(zip(("start_local", "start_utc"), completed_times(local, utc, minutes), strict=True))
    value = lambda c: F.coalesce(full[c], F.col(f"_{c}")) if c in KEPT else F.coalesce(F.col(c), F.lit(DEFAULTS[c])) if c in DEFAULTS else F.col(c)
    return rows.select("owner", "record", F.when(there, "kept").otherwise("deleted").alias("outcome"), *[F.when(there, value(c)).alias(c) for c in fields])
