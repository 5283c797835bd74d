"""Gas lists that came as JSON from anywhere: what of them is a gas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(entry: Column, name: str) -> Column:
    """A member of a JSON object that is written as a number; null for one in quotes, for true and for anything else."""
    member = F.try_variant_get(entry, f"$.{name}", "variant")
    kind = F.schema_of_variant(member)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(entry, f"$.{name}", "double"))


def gases_of(text: Column) -> Column:
    """(o2, he) of those entries of a JSON array that are objects with a number under o2Fraction, in their order; null if
    there is none, or if the text is no JSON array. heFraction is taken where it is a number."""
    entries = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    found = F.transform(entries, lambda e: F.struct(_number(e, "o2Fraction").alias("o2"), _number(e, "heFraction").alias("he")))
    kept = F.filter(found, lambda g: g["o2"].isNotNull())
    return F.when(F.size(kept) > 0, kept)
