"""Free-text tags against a taxonomy: exact, then alias, then fuzzy within an edit budget, else new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import edit_budget, slug

#: A taxonomy is a short list that its caller writes; it is broadcast, and a longer one is refused.
LARGEST = 10_000


def _without(s: Column, most: Column) -> Column:
    """A text and what is left of it without up to `most` (0 to 2) of its letters; two texts within that many edits have one
    of these in common."""
    fewer = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    one = F.when((most > 0) & (F.length(s) > 0), fewer(s)).otherwise(F.array().cast("array<string>"))
    two = F.when(most > 1, F.flatten(F.transform(F.filter(one, lambda t: t != ""), fewer))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(s), one, two))


def match(tags: DataFrame, column: str, taxonomy: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(input, kind, slug, label, distance) for each different non-null tag; taxonomy: (slug, label, aliases) in order.

    Ties go to the earlier entry. distance is null unless the match is fuzzy. Both joins are by equality: exact and alias
    matches by the slug, fuzzy ones by what is left of two slugs without up to two letters, verified by the edit distance.
    """
    rows = [(i, s, label, a) for i, (s, label, aliases) in enumerate(taxonomy) for a in [None, *aliases]]
    if len(rows) > LARGEST:
        raise ValueError(f"a taxonomy has at most {LARGEST} entries and aliases")
    names = tags.sparkSession.createDataFrame(rows, "place int, entry string, label string, alias string")
    names = names.withColumn("form", F.coalesce(slug(F.col("alias")), F.col("entry"))).withColumn("rank", F.when(F.col("alias").isNull(), 0).otherwise(1))
    tried = tags.select(F.col(column).alias("input")).where("input is not null").distinct().withColumn("own", slug(F.col("input")))
    budget = edit_budget(F.col("own"))
    told = [F.col("place"), F.col("entry"), F.col("label")]
    same = tried.join(F.broadcast(names.withColumn("own", F.col("form"))), "own").select("input", F.col("rank").alias("o"), F.lit(None).cast("int").alias("distance"), *told, F.when(F.col("rank") == 1, "alias").otherwise("exact").alias("kind"))
    left = names.where("rank = 0").select(*told, F.col("form"), F.explode(_without(F.col("form"), F.lit(2))).alias("part"))
    parts = tried.where(budget > 0).select("input", "own", F.explode(_without(F.col("own"), budget)).alias("part"))
    near = F.levenshtein("own", "form", 2)
    close = parts.join(F.broadcast(left), "part").where(F.col("own") != F.col("form")).select("input", "own", "form", *told).distinct().where((near >= 0) & (near <= budget))
    fuzzy = close.select("input", F.lit(2).alias("o"), near.alias("distance"), *told, F.lit("fuzzy").alias("kind"))
    best = same.unionByName(fuzzy).groupBy("input").agg(F.min(F.struct("o", "distance", "place", "kind", "entry", "label")).alias("b"))
    return tried.join(best, "input", "left").select("input", F.coalesce("b.kind", F.lit("new")).alias("kind"), F.coalesce("b.entry", "own").alias("slug"), F.coalesce("b.label", F.trim("input")).alias("label"), "b.distance")


def resolved(tags: DataFrame, known: DataFrame) -> DataFrame:
    """(owner, input, slug, tag_id, is_new) of tags (owner, input): the tag of that slug, a common one (owner null) before the
    owner's own, of several the least tag_id; without one the tag is new. known: (owner, slug, tag_id). Empty slugs are dropped.
    """
    asked = tags.select("owner", "input", slug(F.col("input")).alias("slug")).where("slug <> ''").distinct()
    common = known.where("owner is null").groupBy("slug").agg(F.min("tag_id").alias("common"))
    own = known.where("owner is not null").groupBy("owner", "slug").agg(F.min("tag_id").alias("own"))
    found = asked.join(common, "slug", "left").join(own, ["owner", "slug"], "left")
    tag = F.coalesce("common", "own")
    return found.select("owner", "input", "slug", tag.alias("tag_id"), tag.isNull().alias("is_new"))
