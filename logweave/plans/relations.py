"""Queries of names, details, gear, privacy and the changes that readers make."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import offsets
from logweave.operators import linking, lists, merging, relations, search, taxonomy
from logweave.plans.registry import query
from logweave.sources import exports, files, profiles
from logweave.sources.shared import folder, written
from logweave.sources.tables import read


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders")


def key() -> Column:
    return F.col("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 'nobody' ELSE c_name END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def relate_names(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "customer").where("c_custkey % 9 <> 0").select("c_custkey", "c_name")
    return relations.labelled(_orders(spark, d).select("o_orderkey", "o_custkey"), "o_custkey", names, "name", "nobody").select("o_orderkey", "name")


@query("""
WITH t AS (SELECT l_orderkey AS k, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS tags FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey AS k, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS sources FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT o_orderkey, coalesce(tags, '') AS tags, coalesce(sources, '') AS sources FROM orders LEFT JOIN t ON t.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey""")
def relate_details(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    found = relations.detailed(_orders(spark, d).select("o_orderkey"), "o_orderkey", {"tags": (line, "l_returnflag"), "sources": (line.where("l_linenumber % 2 = 0"), "l_suppkey")})
    text = F.array_join(F.transform("sources", lambda x: x.cast("string")), ",")
    return found.select("o_orderkey", F.array_join("tags", ",").alias("tags"), text.alias("sources"))


@query("""
WITH a AS (SELECT l_orderkey AS k, max(CASE WHEN l_linenumber % 3 = 1 AND l_returnflag = 'N' THEN l_quantity END) AS gas, string_agg(DISTINCT 'line' || l_linenumber::VARCHAR, ',' ORDER BY 'line' || l_linenumber::VARCHAR) AS refs FROM lineitem GROUP BY 1)
SELECT o_orderkey AS record, gas, coalesce(refs, '') AS refs FROM orders LEFT JOIN a ON k = o_orderkey""")
def relate_candidates(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    claims = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), F.when(n % 3 == 1, "gases").otherwise("notes").alias("field"), F.concat(F.lit("line"), n).alias("source"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "N").alias("is_selected"))
    return relations.with_first_gas(_orders(spark, d).select(key().alias("record")), claims).select("record", "gas", F.array_join("source_refs", ",").alias("refs"))


GEAR = """
g AS (SELECT o_orderkey AS row, o_custkey % 20 AS owner, unnest(['Fins ' || (o_orderkey % 3)::VARCHAR, 'Old Hood', CASE WHEN o_orderkey % 2 = 0 THEN 'Camera' ELSE 'dry suit' END]) AS piece FROM orders),
i AS (SELECT DISTINCT o_custkey % 20 AS owner, CASE WHEN o_custkey % 3 = 0 THEN ' CAMERA ' ELSE 'fins 1' END AS name FROM orders)"""


def _gear(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    owner = (F.col("o_custkey") % 20).alias("owner")
    text = F.concat(F.lit("Fins "), key() % 3, F.lit('; "Old Hood", '), F.when(key() % 2 == 0, "Camera").otherwise("dry suit"), F.lit(" / old hood"))
    pieces = relations.gear_pieces(_orders(spark, d).select(key().alias("row"), owner, text.alias("gear")), ["row", "owner"], "gear")
    items = _orders(spark, d).select(owner, F.when(F.col("o_custkey") % 3 == 0, " CAMERA ").otherwise("fins 1").alias("name")).distinct()
    return pieces, items.withColumn("item", F.lower(F.trim("name")))


@query(f"WITH {GEAR} SELECT g.row AS row, g.owner AS owner, piece, lower(trim(name)) AS item FROM g JOIN i ON g.owner = i.owner AND lower(piece) = lower(trim(name))")
def relate_gear(spark: SparkSession, d: str) -> DataFrame:
    pieces, items = _gear(spark, d)
    return relations.gear_links(pieces, items, ["owner"]).select("row", "owner", "piece", "item")


@query(f"""WITH {GEAR} SELECT owner, min(piece) AS name, CASE WHEN lower(piece) LIKE 'fins%' THEN 'fins' WHEN lower(piece) = 'old hood' THEN 'hood' WHEN lower(piece) = 'camera' THEN 'camera' ELSE 'drysuit' END AS kind, count(DISTINCT row) AS n
FROM g WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.owner = g.owner AND lower(trim(name)) = lower(piece)) GROUP BY owner, lower(piece)""")
def relate_gear_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return relations.gear_suggestions(*_gear(spark, d), ["owner"], "row")


@query("SELECT o_orderkey AS record, CASE WHEN o_orderkey % 2 = 0 THEN 'notes' ELSE 'rating' END AS field, CASE WHEN o_orderkey % 2 = 0 THEN '[withheld]' ELSE o_orderstatus END AS value FROM orders")
def relate_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select(key().alias("record"), F.when(key() % 2 == 0, "notes").otherwise("rating").alias("field"), F.col("o_orderstatus").alias("value"), "o_orderpriority")
    return relations.visible(relations.redacted(rows, ["notes", "buddies"]), ["record", "field", "value"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unnamed' ELSE o_orderstatus END AS site, 0 AS n_tags FROM orders")
def relate_preview(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select("o_orderkey", F.when(key() % 3 != 0, F.col("o_orderstatus")).alias("site"))
    return relations.preview(rows, {"o_orderkey": F.lit(None).cast("long"), "site": F.lit("unnamed"), "n_tags": F.lit(0)})


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def relate_unassigned(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).withColumn("trip", F.when(F.col("o_custkey") % 4 != 1, F.col("o_custkey")))
    return relations.newest(rows, "o_orderdate", "o_orderkey", 200, F.col("trip").isNull()).select("o_orderkey")


@query("SELECT o_custkey, count(*) AS n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY o_custkey")
def relate_first_and_last(spark: SparkSession, d: str) -> DataFrame:
    return relations.first_and_last(_orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey")


@query("""
WITH s AS (SELECT o_orderpriority AS slug, min(o_orderstatus) AS label FROM orders WHERE o_orderpriority > '2' GROUP BY 1), k AS (SELECT DISTINCT o_orderpriority AS slug FROM orders WHERE o_orderpriority < '4')
SELECT left(sha256(coalesce(s.slug, k.slug)), 32) AS id, coalesce(s.slug, k.slug) AS slug, CASE WHEN s.slug IS NULL THEN 'old' ELSE label END AS label FROM s FULL JOIN k ON s.slug = k.slug""")
def relate_seeds(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select(F.col("o_orderpriority").alias("slug"), F.col("o_orderstatus").alias("label"))
    return relations.seeded(rows.where("slug < '4'").select("slug", F.lit("old").alias("label")).distinct(), rows.where("slug > '2'"), "slug")


@query("""
WITH n AS (SELECT o_custkey AS trip, count(*) AS n FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 AND n.n <= 8 THEN o_custkey END AS trip FROM orders LEFT JOIN n ON n.trip = o_custkey""")
def state_assigned(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select("o_orderkey", F.lit(None).cast("long").alias("trip"))
    wanted = _orders(spark, d).where("o_orderkey % 3 < 2").select("o_orderkey", F.col("o_custkey").alias("value"))
    return relations.assigned(rows, "o_orderkey", "trip", wanted, 8)


@query("SELECT k AS c_custkey, count(o_orderkey) AS n, CASE WHEN max(c_custkey) IS NULL THEN 'unknown' WHEN count(o_orderkey) > 0 THEN 'refused' ELSE 'deleted' END AS outcome FROM (SELECT DISTINCT o_custkey + 5 AS k FROM orders) LEFT JOIN customer ON c_custkey = k AND k % 11 <> 0 LEFT JOIN orders ON o_custkey = k AND o_orderstatus = 'P' GROUP BY k")
def state_removals(spark: SparkSession, d: str) -> DataFrame:
    uses = _orders(spark, d).where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.removals(read(spark, d, "customer").where("c_custkey % 11 <> 0"), uses, _orders(spark, d).select((F.col("o_custkey") + 5).alias("c_custkey")), "c_custkey")


@query("""
WITH c AS (SELECT l_orderkey AS ref, arg_max(l_returnflag, l_linenumber) AS d FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT o_custkey AS batch, o_orderkey AS ref, CASE WHEN o_custkey % 2 = 0 AND d IS NOT NULL THEN d ELSE o_orderstatus END AS decision FROM orders LEFT JOIN c ON ref = o_orderkey""")
def state_overruled(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select(F.col("o_custkey").alias("batch"), key().alias("ref"), F.col("o_orderstatus").alias("decision"))
    batches = rows.select("batch", F.when(F.col("batch") % 2 == 0, "review").otherwise("committed").alias("state")).distinct()
    choices = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("seq")).agg(F.max("l_returnflag").alias("decision")).join(rows.select("batch", "ref"), "ref")
    return relations.overruled(rows, batches, choices)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 60 - (o_orderkey % 5) * 3600 ELSE o_custkey * 60 END AS utc, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey * 60 + (o_orderkey % 5) * 3600 ELSE CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 60 ELSE o_custkey * 60 + 7200 END END AS local_s,
  CASE WHEN o_orderkey % 3 = 2 THEN 120 ELSE (o_orderkey % 5) * 60 END AS minutes FROM orders""")
def clean_times(spark: SparkSession, d: str) -> DataFrame:
    """Any two of universal time, wall clock and offset, and the third from them."""
    s, k = F.col("o_custkey") * 60, key() % 3
    minutes = F.when(k != 2, (key() % 5 * 60).cast("int"))
    done = offsets.completed(F.when(k != 0, s), F.when(k == 0, s).when(k == 2, s + 7200), minutes)
    return _orders(spark, d).select("o_orderkey", done.alias("t")).select("o_orderkey", "t.utc", F.col("t.local").alias("local_s"), "t.minutes")


@query("""
WITH p AS (SELECT c_nationkey AS owner, c_custkey % 30 AS site_id, min(c_custkey) FILTER (c_custkey % 4 <> 0) AS k FROM customer GROUP BY 1, 2)
SELECT s_nationkey AS owner, s_suppkey AS site_id, CASE WHEN s_suppkey % 3 = 0 OR k IS NULL THEN CASE WHEN s_suppkey % 3 = 1 THEN 0.0 WHEN s_suppkey % 3 = 0 THEN 10.0 END ELSE (k % 80)::DOUBLE END AS lat FROM supplier LEFT JOIN p ON p.owner = s_nationkey AND p.site_id = s_suppkey""")
def link_filled_places(spark: SparkSession, d: str) -> DataFrame:
    s, c = F.col("s_suppkey") % 3, F.col("c_custkey")
    sites = read(spark, d, "supplier").select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("site_id"), F.when(s == 0, 10.0).when(s == 1, 0.0).alias("lat"), F.when(s == 0, 10.0).when(s == 1, 0.0).alias("lon"))
    points = read(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), c.alias("point_id"), F.when(c % 4 != 0, (c % 80).cast("double")).alias("lat"), F.lit(7.0).alias("lon"), (c % 30).alias("site_id"))
    return linking.filled_places(sites, points.select("owner", "point_id", "site_id"), points).select("owner", "site_id", "lat")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS owner, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '!' ELSE '' END AS input, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM orders),
     o AS (SELECT o_custkey AS owner, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug, min(o_orderkey) AS tag FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2)
SELECT a.owner AS owner, input, a.slug AS slug, CASE WHEN a.slug LIKE '1%' THEN -1 ELSE tag END AS tag_id, a.slug NOT LIKE '1%' AND tag IS NULL AS is_new FROM a LEFT JOIN o ON o.owner = a.owner AND o.slug = a.slug""")
def link_resolved_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d)
    tags = rows.select(F.col("o_custkey").alias("owner"), F.concat("o_orderpriority", F.when(key() % 2 == 0, "!").otherwise("")).alias("input"))
    form = F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "-"))
    own = rows.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("owner"), form.alias("slug"), key().alias("tag_id"))
    common = rows.where("o_orderpriority like '1%'").select(F.lit(None).cast("long").alias("owner"), form.alias("slug"), F.lit(-1).cast("long").alias("tag_id")).distinct()
    return taxonomy.resolved(tags, own.unionByName(common))


@query("""
SELECT 'trip' AS kind, o_orderkey, row_number() OVER (ORDER BY s DESC NULLS LAST, o_custkey DESC, o_orderkey) AS place FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS s FROM orders)
UNION ALL SELECT 'gear', o_orderkey, row_number() OVER (ORDER BY r NULLS FIRST, o_orderpriority COLLATE en, o_orderkey) FROM (SELECT *, CASE WHEN o_orderkey % 1000 < 5 THEN NULL ELSE o_orderdate END AS r FROM orders)""")
def search_trips_and_gear(spark: SparkSession, d: str) -> DataFrame:
    """Both whole lists; places are those of the sorted partitions, one after the other."""

    def numbered(rows: DataFrame, kind: str) -> DataFrame:
        part, at = F.shiftright(F.monotonically_increasing_id(), 33), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        held = written(rows.select("o_orderkey", part.alias("part"), at.alias("at")))
        sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
        before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        return held.join(F.broadcast(before), "part").select(F.lit(kind).alias("kind"), "o_orderkey", (F.col("before") + F.col("at") + 1).alias("place"))

    rows = _orders(spark, d)
    trips = search.trips_in_order(rows.withColumn("s", F.when(key() % 3 != 0, F.col("o_orderdate"))), "s", "o_custkey", "o_orderkey")
    gear = search.gear_in_order(rows.withColumn("r", F.when(key() % 1000 >= 5, F.col("o_orderdate"))), "r", "o_orderpriority", "o_orderkey")
    return numbered(trips, "trip").unionAll(numbered(gear, "gear"))


PEOPLE = ["Éclair", "eclair", "Zebra", "zebra", "ñandú", "Nandu", "øre", "Ore", "ärger", "Co-op", "coop"]


@query(f"""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT c_nationkey, c_custkey, {PEOPLE}[c_custkey % {len(PEOPLE)} + 1] || ' ' || (c_custkey % 3)::VARCHAR AS name, n FROM customer JOIN n ON o_custkey = c_custkey)
SELECT c_nationkey, c_custkey, name, n, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, name COLLATE en, c_custkey) AS place FROM f""")
def search_placed_facets(spark: SparkSession, d: str) -> DataFrame:
    """Every nation's customers by falling number of orders, then by name in the order of the language."""
    name = F.concat(F.get(F.array(*map(F.lit, PEOPLE)), (F.col("c_custkey") % len(PEOPLE)).cast("int")), F.lit(" "), (F.col("c_custkey") % 3).cast("string"))
    customers = read(spark, d, "customer").select("c_nationkey", "c_custkey", name.alias("name"))
    counts = _orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")).join(customers.select("c_custkey", "c_nationkey"), "c_custkey")
    return search.placed_facets(counts, customers, "c_nationkey", "c_custkey", "name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'profiles/' || o_custkey::VARCHAR || '/' || left(sha256(o_orderpriority), 32) END AS name FROM orders")
def export_profile_keys(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", exports.profile_key(F.col("o_custkey"), F.when(key() % 2 == 0, F.col("o_orderpriority")).cast("binary")).alias("name"))


@query("""
WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || '/' || (o_orderkey % 9)::VARCHAR END AS blob FROM orders),
k AS (SELECT *, 'profiles/' || o_custkey::VARCHAR || '/' || left(sha256(blob), 32) AS key FROM b)
SELECT o_orderkey AS record, key AS storage_key, length(blob)::BIGINT AS byte_size, sha256(blob) AS checksum, blob AS back, (SELECT count(DISTINCT key) FROM k) AS n_objects FROM k""")
def export_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles stored twice over under their content's name, and fetched again by their references."""
    path = f"{folder(spark)}/profiles-{uuid.uuid4().hex}"
    blob = F.when(key() % 5 != 0, F.concat("o_orderpriority", F.lit("/"), (key() % 9).cast("string"))).cast("binary")
    rows = _orders(spark, d).select(F.col("o_custkey").alias("owner"), key().alias("record"), blob.alias("blob"))
    profiles.store(rows.where("record % 2 = 0"), path)
    references = profiles.store(rows, path)
    n = profiles.stored(spark, path).agg(F.count(F.lit(1)).alias("n_objects"))
    back = profiles.fetched(spark, path, references).withColumn("back", F.col("blob").cast("string"))
    return back.join(F.broadcast(n)).select("record", "storage_key", "byte_size", "checksum", "back", "n_objects")


@query("SELECT 'a' AS import, o_orderkey AS id, o_orderstatus AS status, NULL AS kind FROM orders UNION ALL SELECT 'b', event_id, NULL, event_type FROM events")
def import_together(spark: SparkSession, d: str) -> DataFrame:
    a = _orders(spark, d).select(key().alias("id"), F.col("o_orderstatus").alias("status"))
    b = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return files.together({"a": a, "b": b}).select("import", "id", "status", "kind")


@query("SELECT o_orderpriority AS owner, o_custkey AS site, n_name AS region, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0 GROUP BY 1, 2, 3")
def relate_visited(spark: SparkSession, d: str) -> DataFrame:
    dives = _orders(spark, d).select(F.col("o_orderpriority").alias("owner"), F.col("o_custkey").alias("site"))
    sites = read(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("region"))
    return relations.visited(dives, sites, read(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_name"), "owner", "site", "region")


@query("SELECT o_orderkey, o_custkey AS batch, c_nationkey AS owner, c_mktsegment AS kind FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 3 <> 2")
def relate_open_rows(spark: SparkSession, d: str) -> DataFrame:
    state = F.get(F.array(F.lit("review"), F.lit("mapping"), F.lit("committed")), (F.col("c_custkey") % 3).cast("int"))
    batches = read(spark, d, "customer").select(F.col("c_custkey").alias("batch"), F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("kind"), state.alias("state"))
    return relations.open_rows(_orders(spark, d).select("o_orderkey", F.col("o_custkey").alias("batch")), batches, ["review", "mapping"]).select("o_orderkey", "batch", "owner", "kind")


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END) AS sites, count(*) FILTER (o_orderkey % 5 = 0) AS unlocated FROM orders GROUP BY o_custkey")
def list_site_totals(spark: SparkSession, d: str) -> DataFrame:
    return lists.site_totals(_orders(spark, d).withColumn("site", F.when(key() % 5 != 0, F.col("o_orderpriority"))), "o_custkey", "site")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE + 1 ELSE DATE '2024-01-01' END AS recorded FROM orders")
def merge_recorded_at(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.to_date("o_orderdate"), key() % 3
    return _orders(spark, d).select("o_orderkey", merging.recorded_at(F.when(k == 0, day), F.when(k < 2, F.date_add(day, 1)), F.lit("2024-01-01").cast("date")).alias("recorded"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_shipdate DESC, l_linenumber::VARCHAR, l_quantity) AS k FROM lineitem),
     b AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS blob FROM lineitem GROUP BY 1, 2)
SELECT v.l_orderkey AS record, v.l_linenumber::VARCHAR AS source, blob FROM v JOIN b ON b.l_orderkey = v.l_orderkey AND b.l_linenumber = v.l_linenumber WHERE k = 1""")
def merge_profiles(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), F.lit("profile").alias("field"), F.col("l_quantity").alias("value"), (n % 2).alias("rank"), F.col("l_shipdate").alias("recorded_at"), n.cast("string").alias("source"))
    return merging.profiles(merging.resolve(rows), rows.select("record", "source", F.col("value").alias("blob")))
