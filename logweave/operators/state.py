"""State changes as new tables: patches with versions, deletions, moves, merged places, replays and their audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators import running


def patched(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows (key, version, deleted_at, columns...) after changes (key, seq, action, at, columns...), of which
    one, the least, counts for a key and seq.

    Actions: patch sets the columns that the change gives (null: left as it is), delete sets deleted_at, restore clears it,
    create adds the row if there is none. Changes of a key take effect in the order of seq; each raises the version by one.
    """
    unique = changes.groupBy(key, "seq").agg(F.min(F.struct("action", "at", *columns)).alias("c")).select(key, "seq", "c.*")
    last = unique.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(F.struct("action", "at"), F.when(F.col("action").isin("delete", "restore"), F.col("seq"))).alias("_d"),
        F.max(F.col("action") == "create").alias("_new"),
        *[F.max_by(c, F.when(F.col("action").isin("patch", "create") & F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in columns],
    )
    both = rows.withColumn("_there", F.lit(True)).join(last, key, "full").where("_there or _new")
    deleted = F.when(F.col("_d.action") == "delete", F.col("_d.at")).when(F.col("_d").isNull(), F.col("deleted_at"))
    version = F.coalesce("version", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return both.select(key, version.cast("long").alias("version"), deleted.alias("deleted_at"), *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def audit(before: DataFrame, after: DataFrame, key: str, columns: list[str], noise: list[str] | None = None) -> DataFrame:
    """(key, field, old, new): the values that differ between two states of rows that both have; noise columns are left out."""
    shown = [c for c in columns if c not in (noise or [])]
    a = before.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in shown])
    b = after.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in shown])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("old"), F.col(f"b_{c}").alias("new")) for c in shown])
    return a.join(b, key).select(key, F.explode(F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))).alias("p")).select(key, "p.field", "p.old", "p.new")


def fresh(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done yet, once each: a replay of a finished batch gives none."""
    return rows.dropDuplicates(keys).join(done.select(*keys).distinct(), keys, "left_anti")


def committed(rows: DataFrame, records: DataFrame, done: DataFrame) -> DataFrame:
    """(batch, ref, outcome) of decided rows (batch, ref, action, target): created, merged or skipped.

    Rows that are done or repeated, that are pending, or whose target is no record (record) any more are skipped.
    """
    there = records.select(F.col("record").alias("target"), F.lit(True).alias("_there")).distinct()
    known = done.select("batch", "ref", F.lit(True).alias("_done")).distinct()
    first = rows.groupBy("batch", "ref").agg(F.min(F.struct("action", "target")).alias("r")).select("batch", "ref", "r.action", "r.target")
    marked = first.join(known, ["batch", "ref"], "left").join(there, "target", "left")
    outcome = F.when(F.col("_done").isNotNull(), "skipped").when(F.col("action") == "create", "created").when((F.col("action") == "merge") & F.col("_there").isNotNull(), "merged").otherwise("skipped")
    return marked.select("batch", "ref", outcome.alias("outcome"))


def released(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """rows with a reference set to null where what it points to is gone (one column of ids)."""
    ids = gone.select(F.col(gone.columns[0]).alias(column), F.lit(True).alias("_gone")).distinct()
    return rows.join(ids, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone").select(*rows.columns)


def merged_places(sites: DataFrame, moves: DataFrame) -> DataFrame:
    """sites (site_id, name, lat, lon, aliases) after moves (from_id, into_id), which form no chains.

    The place that stays takes the names and aliases of the others as aliases, its own name left out, and coordinates that it
    lacks from the least of them; the others are gone.
    """
    into = sites.join(moves.select(F.col("from_id").alias("site_id"), "into_id").dropDuplicates(["site_id"]), "site_id", "left").withColumn("own", F.col("into_id").isNull()).withColumn("site", F.coalesce("into_id", "site_id"))
    others = F.when(~F.col("own"), F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).otherwise(F.coalesce("aliases", F.array().cast("array<string>")))
    both = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    got = into.groupBy("site").agg(
        F.max(F.when(F.col("own"), F.col("name"))).alias("name"),
        F.min_by(both, F.when(both.isNotNull(), F.struct((~F.col("own")).cast("int"), F.col("site_id")))).alias("place"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(others)))).alias("names"),
    )
    return got.where("name is not null").select(F.col("site").alias("site_id"), "name", "place.lat", "place.lon", F.filter("names", lambda x: x != F.col("name")).alias("aliases"))


def repointed(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """rows with references to merged places moved to those that stay."""
    m = moves.select(F.col("from_id").alias(column), "into_id").dropDuplicates([column])
    return rows.join(m, column, "left").withColumn(column, F.coalesce("into_id", column)).drop("into_id").select(*rows.columns)


def upserted(views: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., name, position) of saved views: a view under a known key changes its name, a new one goes to the end.

    saved: (keys..., seq, name), keys[0] being the owner; of several for a key the last one counts.
    """
    last = saved.groupBy(*keys).agg(F.max_by("name", "seq").alias("_name"), F.min("seq").alias("_seq"))
    both = views.join(last, keys, "full")
    tops = views.groupBy(F.col(keys[0]).alias("_whose")).agg(F.max("position").alias("_top"))
    ranked = running.Ordered(both, keys[0], ["_seq", *keys[1:]]).add(_place=running.count(F.col("position").isNull())).rows()
    placed = ranked.join(tops, F.col(keys[0]).eqNullSafe(F.col("_whose")), "left")
    end = F.coalesce("_top", F.lit(0)) + F.col("_place")
    return placed.select(*keys, F.coalesce("_name", "name").alias("name"), F.coalesce("position", end).cast("long").alias("position"))


def staff_changes(rows: DataFrame, changes: DataFrame, key: str, columns: list[str], entity: str) -> tuple[DataFrame, DataFrame]:
    """(rows, events) after changes by staff (key, seq, action, at, actor, reason, columns...): see patched().

    Both come from one and the same set of changes, so no change lacks its event: events (actor_id, action, entity_type,
    entity_id, reason, created_at, fields), fields being those that a patch names. Of several changes under one key and seq
    the least counts; a change of a row that is not there and is not created by it leaves no event.
    """
    extra = ["actor", "reason"]
    one = changes.groupBy(key, "seq").agg(F.min(F.struct("action", "at", *extra, *columns)).alias("c")).select(key, "seq", "c.*")
    there = rows.select(key).unionByName(one.where("action = 'create'").select(key)).distinct()
    real = one.join(there, key, "left_semi")
    named = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), c) for c in columns]))
    fields = F.when(F.col("action").isin("patch", "create"), named).otherwise(F.array().cast("array<string>"))
    events = real.select(F.col("actor").alias("actor_id"), F.concat(F.lit(f"{entity}."), F.col("action")).alias("action"), F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), "reason", F.col("at").alias("created_at"), F.array_join(fields, ",").alias("fields"))
    return patched(rows, real.drop(*extra), key, columns), events


def audit_log(events: DataFrame, users: DataFrame, entity_type: str | None = None, entity_id: str | None = None, actor_id: object = None, most: int = 200) -> DataFrame:
    """The newest `most` events that meet what is asked (None: anything), with actor_email from users (user_id, email): null
    for an unknown or absent actor. Equal times are ordered by entity, then action."""
    asked = {"entity_type": entity_type, "entity_id": entity_id, "actor_id": actor_id}
    found = events
    for column, value in asked.items():
        found = found if value is None else found.where(F.col(column) == F.lit(value))
    first = found.orderBy(F.desc("created_at"), "entity_type", "entity_id", "action", "actor_id").limit(most)
    # at most `most` rows look for their actors
    emails = users.groupBy(F.col("user_id").alias("actor_id")).agg(F.min("email").alias("actor_email"))
    return first.join(emails, "actor_id", "left")
