"""Queries of importing and exporting: sheets, XML, JSON, uploads, and the cells in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import parsing
from logweave.operators import sheets
from logweave.plans.registry import query
from logweave.sources import exports, files
from logweave.sources.tables import read

def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders")


def text(c: Column) -> Column:
    return c.cast("string")


SHEET = """
s AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
o AS (SELECT k, CASE WHEN k % 50 = 0 THEN NULL ELSE k END AS dive_number,
  CASE WHEN k % 20 = 1 THEN NULL WHEN k % 3 = 0 THEN TIMESTAMP '1899-12-30' + to_days((30000 + k % 9000)::INTEGER) WHEN k % 3 = 1 THEN TIMESTAMP '2024-02-29' END
   + to_seconds(CASE WHEN k % 4 = 0 THEN floor(k % 1000 / 1000.0::DOUBLE * 86400 + 0.5) WHEN k % 4 = 1 THEN (k % 12 + 12) % 24 * 3600 + 1800 WHEN k % 4 = 2 THEN k % 24 * 3600 + 300 + 7 ELSE 0 END::DOUBLE) AS start_local,
  CASE WHEN k % 2 = 0 THEN c % 400 ELSE (c % 1500) * 0.3048::DOUBLE END::DOUBLE AS depth, CASE WHEN k % 7 = 0 THEN NULL ELSE (c % 2000) * 60 END AS duration,
  CASE WHEN k % 5 = 0 THEN (c % 120 - 32) * 5 / 9.0::DOUBLE ELSE c % 50 END::DOUBLE AS water, (c % 200) * 0.45359237::DOUBLE AS weight,
  CASE k % 4 WHEN 0 THEN 'salt' WHEN 1 THEN 'fresh' WHEN 2 THEN 'brackish' END AS water_type, CASE WHEN k % 6 = 0 THEN (c % 40) / 100.0::DOUBLE WHEN k % 6 = 1 THEN 0.21::DOUBLE END AS o2 FROM s)"""


@query(f"""
WITH {SHEET}
SELECT k AS o_orderkey, dive_number, strftime(start_local, '%Y-%m-%d %H:%M:%S') AS started, round(CASE WHEN depth <= 350 THEN depth END, 4) AS max_depth_m, CASE WHEN duration <= 86400 THEN duration END AS duration_s,
  round(CASE WHEN water BETWEEN -2 AND 45 THEN water END, 4) AS water_temp_c, round(CASE WHEN weight <= 60 THEN weight END, 4) AS weight_kg, water_type, round(o2, 4) AS o2,
  concat_ws(',', CASE WHEN k % 20 = 1 THEN 'missing_date' WHEN k % 3 = 2 THEN 'unreadable_date' END, CASE WHEN start_local IS NOT NULL AND k % 4 = 3 THEN 'unreadable_time' END, CASE WHEN k % 50 = 0 THEN 'unreadable_dive_number' END, CASE WHEN k % 4 = 3 THEN 'unknown_water_type' END,
    CASE WHEN depth > 350 THEN 'out_of_range' END, CASE WHEN duration > 86400 THEN 'out_of_range' END, CASE WHEN water NOT BETWEEN -2 AND 45 THEN 'out_of_range' END, CASE WHEN weight > 60 THEN 'out_of_range' END) AS codes
FROM o""")
def import_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as the text cells of a sheet and read back as observations."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    date = F.when(k % 20 == 1, " n/a ").when(k % 3 == 0, text(30_000 + k % 9000)).when(k % 3 == 1, "2024-02-29T00:00").otherwise("2023-02-29")
    clock = F.when(k % 4 == 0, text(k % 1000 / 1000.0)).when(k % 4 == 1, F.concat(text(F.when(k % 12 == 0, 12).otherwise(k % 12)), F.lit(":30 PM"))).when(k % 4 == 2, F.concat(text(k % 24), F.lit(":05:07"))).otherwise("noon")
    cells = {
        "Dive #": F.when(k % 50 == 0, "x").otherwise(text(k)),
        "Date": date,
        "Time In": clock,
        "Max Depth (m)": F.when(k % 2 == 0, text(c % 400)),
        "Max Depth (ft)": text(c % 1500),
        "Duration": F.when(k % 7 != 0, F.format_number(c % 2000, 0)),
        "Water Temp (F)": F.when(k % 5 == 0, text(c % 120)),
        "Water Temp (C)": F.when(k % 5 != 0, text(c % 50)),
        "Weight (lbs)": text(c % 200),
        "Water Type": F.get(F.array(F.lit("Saltwater"), F.lit("Fresh "), F.lit("brackish"), F.lit("oily")), (k % 4).cast("int")),
        "EAN %": F.when(k % 6 == 0, text(c % 40)),
        "Gas": F.when(k % 6 == 1, "AIR").when(k % 6 == 2, "Trimix"),
        "Colour": text(k),
    }
    mapping, _ = sheets.guess(list(cells))
    got = sheets.observations(_orders(spark, d).select("o_orderkey", *[v.alias(n) for n, v in cells.items()]), mapping, ["o_orderkey"])
    four = lambda n: F.round(n, 4).alias(n)
    codes = F.array_join(F.transform("issues", lambda i: i["code"]), ",")
    return got.select("o_orderkey", "dive_number", text(F.col("start_local")).alias("started"), four("max_depth_m"), "duration_s", four("water_temp_c"), four("weight_kg"), "water_type", four("o2"), codes.alias("codes"))


@query("SELECT p_partkey, p_name || '|' || p_brand || '; ' || p_type || '|' || p_partkey::VARCHAR AS parts FROM part")
def import_lists(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat("p_name", F.lit(' ,, "'), "p_brand", F.lit("; "), "p_type", F.lit("\" / '"), F.col("p_partkey").cast("string"), F.lit("'"))
    return read(spark, d, "part").select("p_partkey", F.array_join(parsing.split_list(cell), "|").alias("parts"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate::TIMESTAMP + to_seconds((o_orderkey % 86400)::DOUBLE), '%Y-%m-%d %H:%M:%S') END AS local_time,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 0 ELSE -(o_orderkey % 12) * 60 - 30 END::INTEGER AS offset_minutes FROM orders""")
def import_wall_clock(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderkey") % 86_400
    two = lambda c: F.lpad(text(F.floor(c)), 2, "0")
    zone = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "Z").otherwise(F.concat(F.lit("-"), two(F.col("o_orderkey") % 12), F.lit(":30")))
    day = F.when(F.col("o_orderkey") % 7 == 0, "2023-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    stamp = F.concat(day, F.lit("T"), two(s / 3600), F.lit(":"), two(s / 60 % 60), F.lit(":"), two(s % 60), zone)
    return _orders(spark, d).select("o_orderkey", parsing.wall_clock(stamp).alias("t")).select("o_orderkey", text(F.col("t.local")).alias("local_time"), F.col("t.offset_minutes").alias("offset_minutes"))


@query("""
SELECT o_orderkey, o_totalprice AS max_depth_m, (o_custkey * 10)::DOUBLE AS duration_s, 'site-' || (o_custkey % 10)::VARCHAR AS site_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE (o_custkey % 3) / 10.0::DOUBLE END AS o2,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE (o_custkey % 4)::DOUBLE END AS lead_kg, (o_custkey % 3)::BIGINT AS n_points, strftime(o_orderdate, '%Y-%m-%d 09:30:00') AS started FROM orders""")
def import_xml(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as XML dives, read back, and joined to the sites and mixes that their links name."""
    c = F.col("o_custkey")
    link = lambda prefix, n: F.concat(F.lit(f'<link ref="{prefix}-'), text(n), F.lit('"/>'))
    point = F.concat(F.lit("<waypoint><divetime>15</divetime><depth>"), text(c), F.lit("</depth></waypoint>"))
    fields = exports.xml_dive({"id": text(F.col("o_orderkey")), "datetime": F.date_format("o_orderdate", "yyyy-MM-dd'T'09:30:00'Z'"), "greatestdepth": F.col("o_totalprice"), "diveduration": c * 10, "leadquantity": c % 4})
    dive = F.concat(F.regexp_replace(fields, "</dive>$", ""), link("gone", c), link("site", c % 10), link("mix", c % 3), F.repeat(point, (c % 3).cast("int")), F.lit("</dive>"))
    dive = F.replace(dive, F.lit("<link ref="), F.lit("<link _ref="))
    parsed = _orders(spark, d).select(F.from_xml(dive, files.XML_LOG, {"attributePrefix": "", "mode": "PERMISSIVE"}).alias("x")).select("x.*")
    sites = spark.range(10).select(F.concat(F.lit("site-"), F.col("id")).alias("id"))
    mixes = spark.range(1, 3).select(F.concat(F.lit("mix-"), F.col("id")).alias("id"), (F.col("id") / 10.0).alias("o2"))
    got = files.dives_of_xml(parsed, sites, mixes)
    return got.select(F.col("id").cast("long").alias("o_orderkey"), "max_depth_m", "duration_s", "site_id", "o2", "lead_kg", "n_points", text(F.col("start_local")).alias("started"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id AS owner FROM events WHERE event_id % 3 <> 0")
def import_json(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON log entries of two formats, those of one format read back."""
    entry = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "other").otherwise("log/1").alias("format"), "event_id", F.from_json("props", "k long").alias("props"), "user_id"))
    back = read(spark, d, "events").select(files.parse_json_log(entry, "format string, event_id long, props struct<k:long>, user_id long", "log/1").alias("e")).where("e is not null")
    return back.select("e.event_id", "e.props.k", F.col("e.user_id").alias("owner"))


SNIFFED = [("PK\x03\x04rest", "a.uddf", "zip"), ("<?xml?>\n<UDDF version='3'>", "a.csv", "uddf"), ("<divelog program='Subsurface'>", "a.csv", "subsurface"), ('{"format": "logbook/2"}', "a.csv", "json"), ("a;b,c\n1;2", "a.json", "csv"), ("a b", "a.CSV", "unknown"), ("plain", "a.xml", "uddf"), ('{"a": 1}', "a.json", "unknown"), ("<a,b,c>", "a.txt", "unknown"), ("a,b\nc,d,e", "a.XLSX", "zip"), ("<uddfx", "a", "unknown")]


@query(f"SELECT event_id, {[kind for _, _, kind in SNIFFED]}[event_id % {len(SNIFFED)} + 1] AS kind FROM events")
def import_sniff(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda k: F.get(F.array(*[F.lit(x[k]) for x in SNIFFED]), (F.col("event_id") % len(SNIFFED)).cast("int"))
    return read(spark, d, "events").select("event_id", files.sniffed(pick(1), F.concat(pick(0), F.lit("\n"), "props")).alias("kind"))


@query("""
WITH f AS (SELECT user_id AS owner, event_id AS batch, ts AS at, props AS c, event_type = 'error' AS failed FROM events)
SELECT a.owner AS owner, a.batch AS batch, arg_max(b.batch, (epoch_us(b.at), b.batch)) AS duplicate_of FROM f a LEFT JOIN f b ON a.owner = b.owner AND a.c = b.c AND NOT b.failed AND b.at < a.at GROUP BY 1, 2""")
def import_uploads(spark: SparkSession, d: str) -> DataFrame:
    uploads = read(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("batch"), F.col("ts").alias("at"), F.col("props").alias("content"), (F.col("event_type") == "error").alias("failed"))
    return files.first_uploads(uploads)


@query("""
WITH p AS (SELECT vec_id, i, (embedding[i + 1])::DOUBLE AS v FROM embeddings, unnest(range(len(embedding))) t(i)),
     s AS (SELECT vec_id, i, v, CASE WHEN i % 4 = 1 THEN v END AS temp FROM p WHERE i % 5 <> 0),
     f AS (SELECT *, coalesce(last_value(temp IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(temp IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS held FROM s)
SELECT vec_id, count(*) AS n, round(sum(v), 4) AS depths, round(sum(held), 4) AS temps FROM f GROUP BY vec_id""")
def import_waypoints(spark: SparkSession, d: str) -> DataFrame:
    nothing = F.lit(None).cast("double")
    points = F.transform("embedding", lambda v, i: F.struct((i * 15.0).alias("divetime"), F.when(i % 5 != 0, v.cast("double")).alias("depth"), F.when(i % 4 == 1, v.cast("double")).otherwise(nothing).alias("temperature")))
    got = read(spark, d, "embeddings").select("vec_id", files.waypoints_series(points).alias("s"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 4)
    return got.select("vec_id", F.size("s.time_s").cast("long").alias("n"), total("s.depth_m").alias("depths"), total("s.temp_c").alias("temps"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'drysuit' WHEN 1 THEN 'bcd' WHEN 2 THEN 'regulator' WHEN 3 THEN 'fins' WHEN 4 THEN 'light' ELSE 'other' END AS kind FROM part""")
def import_gear(spark: SparkSession, d: str) -> DataFrame:
    names = ["Dry Suit 4mm", "Old BC", "Regulator set", "Jet FINS", "spare Torch", "knife"]
    return read(spark, d, "part").select("p_partkey", parsing.gear_kind(F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 6).cast("int"))).alias("kind"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 3 = 1 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 4)::DOUBLE END AS lead, (s_suppkey % 4 = 0)::BIGINT AS n_issues FROM supplier")
def import_sentinels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, text(k)).when(k % 3 == 1, F.concat(F.lit("Site_"), F.lpad(F.hex(k), 9, "0"))).otherwise(F.col("s_name"))
    rows = read(spark, d, "supplier").select("s_suppkey", sheets.opaque_name(name, text(k)).alias("name"), (k % 4).cast("double").alias("lead"))
    return sheets.no_sentinel(rows, "lead", 0.0).select("s_suppkey", "name", "lead", F.size("issues").cast("long").alias("n_issues"))


@query("""
SELECT o_orderkey, 'maxDepthM' AS field, o_totalprice::VARCHAR AS value FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'notes', o_orderpriority FROM orders""")
def import_flatten(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("decimal(18,2)").cast("double")).alias("depth"), "o_orderpriority")
    return sheets.flattened(rows, ["o_orderkey"], {"depth": "maxDepthM", "o_orderpriority": "notes"})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status, o_orderpriority AS priority FROM orders")
def import_widen(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("s"), F.col("o_orderpriority").alias("p"))
    return sheets.widened(sheets.flattened(rows, ["o_orderkey"], {"s": "status", "p": "site.name"}), ["o_orderkey"], {"status": "status", "priority": "site.name"})


FOUR = r"regexp_replace(CAST(CAST(floor(({}) * 10000 + 0.5) / 10000 AS DECIMAL(18, 4)) AS VARCHAR), '\.?0+$', '')"


@query(f"""SELECT o_orderkey::VARCHAR AS "Number", {FOUR.format("o_custkey / 0.3048::DOUBLE")} AS "Depth (ft)", {FOUR.format("(o_custkey % 30)::DOUBLE * 9 / 5 + 32")} AS "Water (F)", o_orderpriority AS "Notes" FROM orders""")
def export_sheet(spark: SparkSession, d: str) -> DataFrame:
    return exports.sheet(_orders(spark, d).withColumn("water", F.col("o_custkey") % 30), "o_orderkey", {"Number": ("o_orderkey", None), "Depth": ("o_custkey", "depth"), "Water": ("water", "temp"), "Notes": ("o_orderpriority", None)}, imperial=True)


@query("""SELECT o_orderkey, '<dive><id>' || o_orderkey::VARCHAR || '</id>' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '<notes>' || o_orderpriority || ' &lt;&amp;&quot;&apos;&gt;</notes>' END || '</dive>' AS xml FROM orders""")
def export_xml(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", exports.xml_dive({"id": F.col("o_orderkey"), "notes": F.when(F.col("o_orderkey") % 3 != 0, F.concat("o_orderpriority", F.lit(" <&\"'>")))}).alias("xml"))


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"status":"' || o_orderstatus || '"' END || ',"priority":"' || o_orderpriority || '"}' AS json FROM orders""")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return rows.select("o_orderkey", exports.json_dive(["o_orderkey", "status", "priority"]).alias("json"))


@query("SELECT min(o_orderkey) AS first, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderpriority, o_orderstatus")
def export_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return exports.dictionary(_orders(spark, d), "o_orderkey", ["o_orderpriority", "o_orderstatus"])
