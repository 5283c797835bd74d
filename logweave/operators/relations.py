"""Rows with what belongs to them: names, details, gear, candidates for matching, and what a reader may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.parsing import gear_kind, split_list
from logweave.functions.series import decode

WITHHELD = "[withheld]"


def labelled(df: DataFrame, key: str, names: DataFrame, name: str, missing: str | None = None) -> DataFrame:
    """df with the name of what its key points to (names: key, name); `missing` where it points to nothing or is null."""
    known = names.groupBy(F.col(names.columns[0]).alias(key)).agg(F.min(names.columns[1]).alias(name))
    return df.join(known, key, "left").withColumn(name, F.coalesce(name, F.lit(missing)))


def detailed(df: DataFrame, key: str, relations: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """df with one sorted list for each relation (rows with the key, and the column to list), empty where there are none.

    Each relation is aggregated by the key before it is joined, so relations do not multiply one another.
    """
    for name, (rows, column) in relations.items():
        own = rows.where(F.col(column).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(column)).alias(name))
        df = df.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return df


def nested(df: DataFrame, key: str, name: str, rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """df with one list of structures (columns) of the rows that have its key, in the given order, empty where there are none."""
    kept = [c for c in columns if c not in order]
    entry = F.struct(*order, *kept)
    own = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(*[e[c].alias(c) for c in columns])).alias(name))
    return df.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))


def whole_dives(dives: DataFrame, sites: DataFrame, tags: DataFrame, buddies: DataFrame, sources: DataFrame, assertions: DataFrame, profiles: DataFrame) -> DataFrame:
    """dives (dive, site_id, ...) with all that belongs to them: site, tags, buddies, sources, provenance and profile.

    sites: (site_id, name, lat, lon); tags: (dive, label) and buddies: (dive, name), as sorted lists; sources: (dive, source,
    kind, recorded_at), by time; assertions: (dive, field, source, value, is_selected), by field and source; profiles: (dive,
    blob). Each relation is gathered by its dive before it is joined, so none multiplies another. What a dive lacks is an
    empty list, a null site or a null profile; of several sites under one id, or profiles of one dive, the least counts.
    """
    known = sites.groupBy("site_id").agg(F.min(F.struct("name", "lat", "lon")).alias("site"))
    one = profiles.groupBy("dive").agg(F.min("blob").alias("profile"))
    rows = dives.join(known, "site_id", "left").join(one, "dive", "left")
    rows = detailed(rows, "dive", {"tags": (tags, "label"), "buddies": (buddies.withColumnRenamed("name", "buddy"), "buddy")})
    rows = nested(rows, "dive", "sources", sources, ["recorded_at", "source"], ["source", "kind", "recorded_at"])
    return nested(rows, "dive", "provenance", assertions, ["field", "source"], ["field", "source", "value", "is_selected"])


def export_plan(dives: DataFrame, owner: str, who: object, channel: str = "depthM", **relations_of: DataFrame) -> DataFrame:
    """whole_dives() of one owner's live dives (owner, deleted_at), in order of universal time (start_utc), with the profile's
    samples of a channel: null where there is no blob or it cannot be read, which costs a dive its profile and nothing else."""
    mine = dives.where((F.col(owner) == F.lit(who)) & F.col("deleted_at").isNull())
    return whole_dives(mine, **relations_of).withColumn("samples", decode(F.col("profile"), channel)).orderBy("start_utc", "dive")


def with_first_gas(records: DataFrame, assertions: DataFrame) -> DataFrame:
    """Candidates for matching: records (record, ...) with the value of their selected `gases` assertion and all source ids.

    assertions: (record, field, source, value, is_selected); a record without assertions has no gas and no sources.
    """
    own = assertions.groupBy("record").agg(F.max(F.when((F.col("field") == "gases") & F.col("is_selected"), F.col("value"))).alias("gas"), F.array_sort(F.collect_set("source")).alias("source_refs"))
    return records.join(own, "record", "left").withColumn("source_refs", F.coalesce("source_refs", F.array().cast("array<string>")))


def gear_pieces(df: DataFrame, key: list[str], gear: str) -> DataFrame:
    """(key..., piece): the parts of a gear text, each once for a row, spelled as first written."""
    parts = df.select(*key, F.posexplode(split_list(F.col(gear))).alias("at", "piece"))
    return parts.groupBy(*key, F.lower("piece").alias("form")).agg(F.min_by("piece", "at").alias("piece")).drop("form")


def gear_links(pieces: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """pieces (by..., piece) joined to items (by..., item, name) of the same name in any case."""
    return pieces.withColumn("form", F.lower("piece")).join(items.select(*by, "item", F.lower(F.trim("name")).alias("form")), [*by, "form"]).drop("form")


def gear_suggestions(pieces: DataFrame, items: DataFrame, by: list[str], row: str) -> DataFrame:
    """(by..., name, kind, n): pieces that no item of theirs is called, with the rows that mention them."""
    known = items.select(*by, F.lower(F.trim("name")).alias("form")).distinct()
    left = pieces.withColumn("form", F.lower("piece")).join(known, [*by, "form"], "left_anti")
    return left.groupBy(*by, "form").agg(F.min("piece").alias("name"), F.count_distinct(row).alias("n")).select(*by, "name", gear_kind(F.col("name")).alias("kind"), "n")


def visible(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns, in their order; a column that df lacks is an error, so a typing mistake shows nothing."""
    return df.select(*[F.col(f"`{c}`") for c in allowed])


def redacted(provenance: DataFrame, private: list[str], field: str = "field", value: str = "value") -> DataFrame:
    """Provenance rows whose private fields' values are replaced by a mark; null values stay null."""
    return provenance.withColumn(value, F.when(F.col(field).isin(private) & F.col(value).isNotNull(), WITHHELD).otherwise(F.col(value)))


def preview(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns of a preview, each with what to show where it is null."""
    return df.select(*[F.coalesce(F.col(name), default).alias(name) if name in df.columns else default.alias(name) for name, default in columns.items()])


def newest(df: DataFrame, when: str, key: str, most: int, keep: Column | None = None) -> DataFrame:
    """The `most` newest rows that meet a condition, ties by falling key, rows without a time last."""
    return (df if keep is None else df.where(keep)).orderBy(F.desc_nulls_last(when), F.desc(key)).limit(most)


def first_and_last(df: DataFrame, owner: str, when: str, key: str) -> DataFrame:
    """(owner, n, first_key, last_key): each owner's first and last row in time, ties by key; rows without a time do not count."""
    at = F.struct(when, key)
    return df.where(F.col(when).isNotNull()).groupBy(owner).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).select(owner, "n", F.col(f"a.{key}").alias("first_key"), F.col(f"b.{key}").alias("last_key"))


def seeded(known: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """(id, key, columns...) of reference rows after an upsert by key: ids are made from the key, so they are the same each time.

    A seed replaces a known row of its key, of several the least; known rows without a seed stay.
    """
    columns = [c for c in seeds.columns if c != key]
    new = seeds.groupBy(key).agg(F.min(F.struct(*columns)).alias("s"))
    both = known.select(key, F.struct(*columns).alias("k")).join(new, key, "full")
    return both.select(F.substring(F.sha2(key, 256), 1, 32).alias("id"), key, *[F.coalesce(F.col("s"), F.col("k"))[c].alias(c) for c in columns])


def assigned(rows: DataFrame, key: str, column: str, wanted: DataFrame, most: int = 500) -> DataFrame:
    """rows with `column` set for the keys in wanted (key, value); a value with more than `most` keys is refused whole."""
    asked = wanted.select(F.col(wanted.columns[0]).alias(key), F.col(wanted.columns[1]).alias("value")).distinct()
    few = asked.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    asked = asked.join(few, "value", "left_semi")
    last = asked.groupBy(key).agg(F.max("value").alias("_value"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("_value", column)).drop("_value").select(*rows.columns)


def removals(items: DataFrame, uses: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(key, n, outcome) of items asked to be deleted: deleted, refused while something uses them, or unknown."""
    used = uses.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    there = items.select(key, F.lit(True).alias("_there")).distinct()
    marked = asked.select(key).distinct().join(there, key, "left").join(used, key, "left")
    outcome = F.when(F.col("_there").isNull(), "unknown").when(F.col("n") > 0, "refused").otherwise("deleted")
    return marked.select(key, F.coalesce("n", F.lit(0)).alias("n"), outcome.alias("outcome"))


def overruled(rows: DataFrame, batches: DataFrame, choices: DataFrame) -> DataFrame:
    """(batch, ref, decision): decided rows after a reader's choices (batch, ref, seq, decision), the last one of each row.

    Only rows of batches in state review (batch, state) may be changed; choices for others are ignored.
    """
    last = choices.groupBy("batch", "ref").agg(F.max_by("decision", "seq").alias("chosen"))
    open_ = batches.where("state = 'review'").select("batch").distinct()
    return rows.join(last.join(open_, "batch", "left_semi"), ["batch", "ref"], "left").select("batch", "ref", F.coalesce("chosen", "decision").alias("decision"))


def visited(dives: DataFrame, sites: DataFrame, regions: DataFrame, owner: str, site: str, region: str) -> DataFrame:
    """(owner, site, region, n): the sites where each owner dived, with the region's name (regions: region, name), null if none.

    Dives at no known site are left out; dives are counted before they are joined.
    """
    counted = dives.where(F.col(site).isNotNull()).groupBy(owner, site).agg(F.count(F.lit(1)).alias("n"))
    known = sites.select(site, region).dropDuplicates([site])
    names = regions.select(F.col(regions.columns[0]).alias(region), F.col(regions.columns[1]).alias("_name")).dropDuplicates([region])
    return counted.join(known, site).join(names, region, "left").select(owner, site, F.col("_name").alias("region"), "n")


def open_rows(rows: DataFrame, batches: DataFrame, states: list[str]) -> DataFrame:
    """Import rows with the owner and kind of their batch (batches: batch, owner, kind, state), of batches in these states."""
    return rows.join(batches.where(F.col("state").isin(states)).select("batch", "owner", "kind").dropDuplicates(["batch"]), "batch")
