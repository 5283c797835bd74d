"""Queries of records over their life: what disagrees on the screen, imports taken back, changes by staff, sheets and views."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import display, series
from logweave.operators import filters, lists, merging, relations, reverts, state
from logweave.plans.registry import query
from logweave.sources import exports, files
from logweave.sources.shared import folder
from logweave.sources.tables import read

FEET = display.Units("imperial", weight="kg")
SHOWN = """
a AS (SELECT l_orderkey AS record, ['maxDepthM', 'waterTempMinC', 'durationS', 'weightKg', 'startTimeLocal', 'rating', 'waterType'][l_partkey % 7 + 1] AS field, l_quantity AS q, l_partkey % 7 AS k, l_shipdate AS t, l_returnflag AS r FROM lineitem),
s AS (SELECT DISTINCT record, field, CASE k WHEN 0 THEN printf('%.0f ft', q / 0.3048::DOUBLE) WHEN 1 THEN printf('%.0f °F', q * 9 / 5 + 32) WHEN 2 THEN printf('%.0f min', floor(q * 7 / 60::DOUBLE + 0.5)) WHEN 3 THEN printf('%.1f kg', q) WHEN 4 THEN strftime(t, '%Y-%m-%d %H:%M') WHEN 5 THEN (q / 4)::DECIMAL(18, 2)::DOUBLE::VARCHAR ELSE r END AS shown FROM a)"""


@query(f"""
WITH {SHOWN}
SELECT record, field, string_agg(CASE WHEN field = 'rating' THEN regexp_replace(shown, '\\.0$', '') ELSE shown END, '; ' ORDER BY CASE WHEN field = 'rating' THEN regexp_replace(shown, '\\.0$', '') ELSE shown END) AS shown FROM s GROUP BY record, field HAVING count(*) > 1""")
def merge_shown_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Disagreements as a reader with feet and degrees Fahrenheit, but kilograms, sees them."""
    k, q = (F.col("l_partkey") % 7).cast("int"), F.col("l_quantity")
    field = F.get(F.array(*map(F.lit, ["maxDepthM", "waterTempMinC", "durationS", "weightKg", "startTimeLocal", "rating", "waterType"])), k)
    value = F.when(k == 4, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS")).when(k == 6, F.col("l_returnflag")).when(k == 2, (q * 7).cast("string")).when(k == 5, (q / 4).cast("string")).otherwise(q.cast("string"))
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), field.alias("field"), value.alias("value"))
    found = merging.shown_conflicts(rows, display.field_value(F.col("field"), F.col("value"), FEET))
    return found.withColumn("shown", F.array_join("shown", "; "))


LEFT = """
s AS (SELECT l_suppkey % 9 AS owner, l_orderkey AS record, l_linenumber AS batch, l_partkey AS rw, l_linenumber % 3 AS kind, l_shipdate AS said, CASE WHEN l_partkey % 2 = 0 THEN l_shipdate END AS start_local, CASE WHEN l_partkey % 5 = 0 THEN l_shipdate + INTERVAL 3 HOUR END AS start_utc,
  CASE WHEN l_partkey % 3 = 0 THEN 120 END AS offset_minutes, CASE WHEN l_partkey % 4 <> 0 THEN (l_partkey % 50)::DOUBLE END AS max_depth_m, CASE WHEN l_partkey % 7 = 0 THEN 'water ' || (l_partkey % 3)::VARCHAR END AS water_type FROM lineitem),
x AS (SELECT *, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank FROM s),
t AS (SELECT owner, record, bool_and(batch IN (1, 3)) AS gone FROM s GROUP BY 1, 2 HAVING bool_or(batch IN (1, 3))),
v AS (SELECT owner, record, arg_min(start_local, (rank, -epoch_us(said), batch, rw)) FILTER (start_local IS NOT NULL) AS sl, arg_min(start_utc, (rank, -epoch_us(said), batch, rw)) FILTER (start_utc IS NOT NULL) AS su, arg_min(offset_minutes, (rank, -epoch_us(said), batch, rw)) FILTER (offset_minutes IS NOT NULL) AS om,
  arg_min(max_depth_m, (rank, -epoch_us(said), batch, rw)) FILTER (max_depth_m IS NOT NULL) AS md, arg_min(water_type, ((rank + 2) % 3, -epoch_us(said), batch, rw)) FILTER (water_type IS NOT NULL) AS wt FROM x WHERE batch NOT IN (1, 3) GROUP BY 1, 2)"""


@query(f"""
WITH {LEFT}
SELECT t.owner AS owner, t.record AS record, CASE WHEN gone THEN 'deleted' ELSE 'kept' END AS outcome, CASE WHEN NOT gone THEN strftime(coalesce(sl, su + to_minutes(om), TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M') END AS start_local, CASE WHEN NOT gone THEN strftime(coalesce(su, sl - to_minutes(om), sl, TIMESTAMP '2000-01-02'), '%Y-%m-%d %H:%M') END AS start_utc,
  CASE WHEN NOT gone THEN coalesce(om, 0) END AS offset_minutes, md AS max_depth_m, wt AS water_type FROM t LEFT JOIN v ON v.owner = t.owner AND v.record = t.record""")
def merge_reverted(spark: SparkSession, d: str) -> DataFrame:
    """Batches 1 and 3 taken back: records from the sources left, what nothing asserts any more cleared."""
    p, at = F.col("l_partkey"), F.col("l_shipdate")
    kind = F.get(F.array(F.lit("uddf"), F.lit("manual"), F.lit("csv")), (F.col("l_linenumber") % 3).cast("int"))
    sources = read(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 9).alias("owner"), F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("batch"), p.alias("row"), kind.alias("kind"), F.lit(None).cast("string").alias("source_ref"), at.alias("recorded_at"),
        F.when(p % 2 == 0, at).alias("start_local"), F.when(p % 5 == 0, at + F.make_dt_interval(hours=F.lit(3))).alias("start_utc"), F.when(p % 3 == 0, F.lit(120)).alias("offset_minutes"), F.when(p % 4 != 0, (p % 50).cast("double")).alias("max_depth_m"), F.when(p % 7 == 0, F.concat(F.lit("water "), (p % 3).cast("string"))).alias("water_type"),
    )
    fields = {"start_local": "startTimeLocal", "start_utc": "startTimeUtc", "offset_minutes": "tzOffsetMinutes", "max_depth_m": "maxDepthM", "water_type": "waterType"}
    kind_of = sources.schema["start_local"].dataType
    records = sources.select("owner", "record").distinct().withColumns({"start_local": F.lit("2000-01-01").cast(kind_of), "start_utc": F.lit("2000-01-02").cast(kind_of)})
    gone = sources.select("batch").distinct().where("batch in (1, 3)")
    minute = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return reverts.reverted(records, sources, gone, fields).select("owner", "record", "outcome", minute("start_local"), minute("start_utc"), "offset_minutes", "max_depth_m", "water_type")


STAFF = """
c AS (SELECT l_orderkey * 3 AS k, l_linenumber AS seq, CASE l_returnflag WHEN 'A' THEN 'patch' WHEN 'N' THEN 'delete' ELSE 'restore' END AS action, l_shipdate AS moment, l_suppkey AS actor, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice END AS price FROM lineitem),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k, seq ORDER BY action, moment, actor, price NULLS FIRST) = 1),
r AS (SELECT u.* FROM u JOIN orders ON o_orderkey = k)"""


def _staff(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "orders").select("o_orderkey", F.lit(1).alias("version"), F.lit(None).cast("timestamp").alias("deleted_at"), "o_totalprice")
    action = F.when(F.col("l_returnflag") == "A", "patch").when(F.col("l_returnflag") == "N", "delete").otherwise("restore")
    changes = read(spark, d, "lineitem").select((F.col("l_orderkey") * 3).alias("o_orderkey"), F.col("l_linenumber").alias("seq"), action.alias("action"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_suppkey").alias("actor"), F.lit("asked").alias("reason"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice")).alias("o_totalprice"))
    return state.staff_changes(rows, changes, "o_orderkey", ["o_totalprice"], "dive")


@query(f"WITH {STAFF} SELECT actor AS actor_id, 'dive.' || action AS action, k::VARCHAR AS entity_id, strftime(moment, '%Y-%m-%d') AS day, CASE WHEN action = 'patch' AND price IS NOT NULL THEN 'o_totalprice' ELSE '' END AS fields FROM r")
def state_staff_events(spark: SparkSession, d: str) -> DataFrame:
    return _staff(spark, d)[1].select("actor_id", "action", "entity_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "fields")


@query(f"""
WITH {STAFF},
g AS (SELECT k, count(*) AS n, arg_max(price, seq) FILTER (action = 'patch' AND price IS NOT NULL) AS price, arg_max(action, seq) FILTER (action <> 'patch') AS act, arg_max(moment, seq) FILTER (action <> 'patch') AS moment FROM r GROUP BY k)
SELECT o_orderkey, 1 + coalesce(n, 0) AS version, strftime(CASE WHEN act = 'delete' THEN moment END, '%Y-%m-%d') AS deleted_on, coalesce(price, o_totalprice) AS o_totalprice FROM orders LEFT JOIN g ON k = o_orderkey""")
def state_staff_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _staff(spark, d)[0]
    return rows.select("o_orderkey", "version", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted_on"), "o_totalprice")


@query(f"""
WITH {STAFF}, n AS (SELECT *, row_number() OVER (ORDER BY moment DESC, k::VARCHAR, action, actor) AS i FROM r WHERE actor = 7)
SELECT k::VARCHAR AS entity_id, 'dive.' || action AS action, strftime(moment, '%Y-%m-%d') AS day, s_name AS actor_email FROM n LEFT JOIN supplier ON s_suppkey = 7 WHERE i <= 200""")
def state_audit_log(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 events of one actor."""
    users = read(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("email"))
    found = state.audit_log(_staff(spark, d)[1], users, entity_type="dive", actor_id=7)
    return found.select("entity_id", "action", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "actor_email")


@query("""
SELECT o_orderkey::VARCHAR AS "Dive Number", strftime(o_orderdate, '%Y-%m-%d') AS "Date", strftime(o_orderdate + to_minutes(o_orderkey % 1440), '%H:%M') AS "Time In", CASE WHEN o_custkey % 4 <> 0 THEN floor(o_custkey / 60::DOUBLE + 0.5)::BIGINT::VARCHAR END AS "Duration (min)",
  regexp_replace((floor(o_custkey % 100 / 0.3048::DOUBLE * 10000 + 0.5) / 10000)::DECIMAL(18, 4)::VARCHAR, '\\.?0+$', '') AS "Max Depth (ft)", NULL::VARCHAR AS "Air Temperature (F)", regexp_replace(((o_custkey % 30) * 9 / 5::DOUBLE + 32)::DECIMAL(18, 4)::VARCHAR, '\\.?0+$', '') AS "Water Temperature (F)", NULL::VARCHAR AS "Visibility (ft)",
  CASE WHEN o_custkey % 3 <> 0 THEN 'Region ' || (o_custkey % 5)::VARCHAR END AS "Location", CASE WHEN o_custkey % 3 <> 0 THEN '1,000 "Steps" ' || (o_custkey % 9)::VARCHAR END AS "Dive Site", CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 80 + 0.5)::VARCHAR END AS "Latitude", CASE WHEN o_custkey % 3 <> 0 THEN (-(o_custkey % 9))::VARCHAR END AS "Longitude",
  'salt' AS "Water Type", 'Shore, Night' AS "Dive Type", CASE o_orderkey % 3 WHEN 0 THEN '21' WHEN 1 THEN '32' END AS "EAN %", o_orderpriority AS "Equipment", regexp_replace((floor((o_custkey % 12) / 0.45359237::DOUBLE * 10000 + 0.5) / 10000)::DECIMAL(18, 4)::VARCHAR, '\\.?0+$', '') AS "Weight (lbs)", '' AS "Buddies", (o_orderkey % 6)::VARCHAR AS "Rating", o_orderstatus AS "Notes" FROM orders""")
def export_logbook_sheet(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("double")
    site = F.struct(F.concat(F.lit("Region "), (c % 5).cast("string")).alias("region"), F.concat(F.lit('1,000 "Steps" '), (c % 9).cast("string")).alias("name"), (c % 80 + 0.5).alias("lat"), (-(c % 9)).cast("double").alias("lon"))
    gas = lambda o2: F.array(F.struct(F.lit(o2).alias("o2"), none.alias("he")))
    dives = read(spark, d, "orders").select(
        k.alias("dive_number"), (F.col("o_orderdate") + F.make_dt_interval(mins=(k % 1440).cast("int"))).alias("start_local"), F.when(c % 4 != 0, c).alias("duration_s"), (c % 100).alias("max_depth_m"), none.alias("air_temp_c"), (c % 30).alias("water_temp_c"), none.alias("visibility_m"), F.when(c % 3 != 0, site).alias("site"),
        F.lit("salt").alias("water_type"), F.array(F.lit("Shore"), F.lit("Night")).alias("tags"), F.when(k % 3 == 0, gas(0.21)).when(k % 3 == 1, gas(0.32)).alias("gases"), F.col("o_orderpriority").alias("gear"), (c % 12).alias("weight_kg"), F.array().cast("array<string>").alias("buddies"), (k % 6).alias("rating"), F.col("o_orderstatus").alias("notes"),
    )
    return exports.logbook_sheet(dives, "dive_number", imperial=True)


@query("""
SELECT o_orderkey::VARCHAR AS number, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'a "b"; ' || o_orderpriority || chr(10) || 'next' END AS notes, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders""")
def import_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as a sheet with semicolons, quotes, line ends and blank rows, read back with its delimiter found."""
    path, k = f"{folder(spark)}/sheet-{uuid.uuid4().hex}", F.col("o_orderkey")
    rows = read(spark, d, "orders").select(k.cast("string").alias(" Number "), F.when(k % 3 != 0, F.concat(F.lit('a "b"; '), "o_orderpriority", F.lit("\nnext"))).alias("Notes"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("Status"))
    blank = rows.where(k % 7 == 0).select(*[F.lit(None).cast("string").alias(c) for c in rows.columns])
    rows.unionByName(blank).write.options(header=True, sep=";", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = files.read_delimited(spark, path)
    return back.where("_ragged is null").select(F.col("Number").alias("number"), F.col("Notes").alias("notes"), F.col("Status").alias("status"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'from=2024-01-02&tags=a,b' WHEN 1 THEN '' WHEN 2 THEN 'q=x y&sort=deepest' WHEN 3 THEN '' ELSE 'minDepth=' || (event_id % 40)::VARCHAR || '.0' END AS canonical FROM events")
def filter_view_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Saved views as their readers wrote them, in one spelling; orders that do not exist make a view unreadable."""
    k = F.col("event_id") % 5
    view = F.when(k == 0, "?tags=b,a,b&cursor=9&from=2024-01-02&limit=20").when(k == 1, "sort=sideways").when(k == 2, "sort=deepest&q=x%20y").when(k == 3, "from=soon").otherwise(F.concat(F.lit("sort=newest&minDepth="), (F.col("event_id") % 40).cast("string")))
    return filters.canonical_views(read(spark, d, "events").select("event_id", view.alias("view")), "view").select("event_id", "canonical")


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-16' AND value >= 40 GROUP BY user_id")
def filter_totals(spark: SparkSession, d: str) -> DataFrame:
    asked = filters.LogQuery(first_day=datetime.date(2024, 1, 5), last_day=datetime.date(2024, 1, 15), least=40.0)
    return filters.totals(read(spark, d, "events"), asked, ["user_id"], "ts", "value", [])


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", sum(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 5 END)::BIGINT AS issues, sum(o_orderkey % 3)::BIGINT AS normalizations FROM orders GROUP BY o_custkey")
def list_import_sizes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").withColumns({"issues": F.when(k % 5 != 0, F.array_repeat(F.lit("i"), (k % 5).cast("int"))), "normalizations": F.array_repeat(F.lit("n"), (k % 3).cast("int"))})
    return lists.import_stats(rows, "o_custkey", "o_orderstatus", ["F", "O"], ["issues", "normalizations"])


@query("""
SELECT l_suppkey, count(*) AS n, max(CASE WHEN l_partkey % 4 <> 0 THEN l_quantity END) AS deepest, sum(CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_linenumber * 60 END)::BIGINT AS bottom_time_s, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day FROM lineitem GROUP BY l_suppkey""")
def list_page_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the page of a site or trip says of its dives: the deepest known one, and the bottom time, unknown ones as none."""
    dives = read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_partkey") % 4 != 0, F.col("l_quantity")).alias("depth"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_linenumber") * 60).alias("seconds"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return lists.page_totals(dives, "l_suppkey", "depth", "seconds", "day")


def _whole(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Orders as dives with lines as tags, buddies, sources and assertions."""
    line, k = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "dive"), F.col("o_orderkey")
    source = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"))
    dives = read(spark, d, "orders").select(k.alias("dive"), F.col("o_custkey").alias("owner"), (k % 50).alias("site_id"), F.col("o_orderdate").alias("start_utc"), F.when(k % 9 == 0, F.col("o_orderdate")).alias("deleted_at"))
    blob = series.encode({"depthM": F.array((k % 20).cast("double"), F.lit(1.5))})
    return dives, {
        "sites": read(spark, d, "supplier").where("s_suppkey < 40").select(F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")),
        "tags": line.where("l_partkey % 3 = 0").select("dive", F.col("l_returnflag").alias("label")),
        "buddies": line.where("l_partkey % 5 = 0").select("dive", F.col("l_linestatus").alias("name")),
        "sources": line.select("dive", source.alias("source"), F.lit("csv").alias("kind"), F.col("l_shipdate").alias("recorded_at")),
        "assertions": line.select("dive", F.lit("maxDepthM").alias("field"), source.alias("source"), F.col("l_quantity").cast("string").alias("value"), (F.col("l_linenumber") == 1).alias("is_selected")),
        # some blobs cannot be read, some dives have none
        "profiles": read(spark, d, "orders").where(k % 4 != 0).select(k.alias("dive"), F.when(k % 4 == 1, F.lit("broken").cast("binary")).otherwise(blob).alias("blob")),
    }


WHOLE = """
l AS (SELECT l_orderkey AS dive, 'line ' || l_linenumber::VARCHAR || '/' || l_partkey::VARCHAR AS source, * FROM lineitem),
g AS (SELECT dive, coalesce(string_agg(l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_partkey % 3 = 0), '') AS tags, coalesce(string_agg(l_linestatus, ',' ORDER BY l_linestatus) FILTER (l_partkey % 5 = 0), '') AS buddies,
  string_agg(source, ',' ORDER BY l_shipdate, source) AS sources, string_agg(source || '=' || l_quantity::DOUBLE::VARCHAR || CASE WHEN l_linenumber = 1 THEN '!' ELSE '' END, ',' ORDER BY source, l_quantity::DOUBLE::VARCHAR, l_linenumber = 1) AS provenance FROM l GROUP BY dive)"""


@query(f"""
WITH {WHOLE}
SELECT o_orderkey AS dive, s_name AS site, coalesce(tags, '') AS tags, coalesce(buddies, '') AS buddies, coalesce(sources, '') AS sources, coalesce(provenance, '') AS provenance FROM orders LEFT JOIN g ON dive = o_orderkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 50 AND s_suppkey < 40""")
def relate_whole_dives(spark: SparkSession, d: str) -> DataFrame:
    dives, parts = _whole(spark, d)
    got = relations.whole_dives(dives, **parts)
    line = lambda c, say: F.array_join(F.transform(c, say), ",")
    said = line("provenance", lambda p: F.concat(p["source"], F.lit("="), p["value"], F.when(p["is_selected"], "!").otherwise("")))
    return got.select("dive", F.col("site.name").alias("site"), F.array_join("tags", ",").alias("tags"), F.array_join("buddies", ",").alias("buddies"), line("sources", lambda s: s["source"]).alias("sources"), said.alias("provenance"))


@query(f"""
WITH {WHOLE}
SELECT o_orderkey AS dive, coalesce(tags, '') AS tags, CASE WHEN o_orderkey % 4 > 1 THEN (o_orderkey % 20)::DOUBLE + 1.5 END AS depths FROM orders LEFT JOIN g ON dive = o_orderkey WHERE o_custkey = 7 AND o_orderkey % 9 <> 0""")
def export_plan(spark: SparkSession, d: str) -> DataFrame:
    """One owner's live dives for an export; damaged and missing profiles cost only themselves."""
    dives, parts = _whole(spark, d)
    got = relations.export_plan(dives, "owner", 7, **parts)
    return got.select("dive", F.array_join("tags", ",").alias("tags"), F.aggregate("samples", F.lit(0.0), lambda acc, v: acc + v).alias("depths"))
