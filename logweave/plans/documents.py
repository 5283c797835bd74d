"""Queries of whole documents: one XML logbook for each owner, written, and read back with all its parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.gases import gases_of
from logweave.plans.registry import query
from logweave.sources import documents, exports, files
from logweave.sources.shared import folder
from logweave.sources.tables import read

MADE = "2026-01-01T00:00:00.000Z"


def _logbooks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as dives of logbooks, one for each nation."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = lambda x: x.cast("double")
    site = F.struct(F.when(c % 10 != 0, F.concat(F.lit("Site & "), (c % 40).cast("string"))).alias("name"), number(c % 40).alias("lat"), number(-(c % 40) * 2).alias("lon"), F.lit(None).cast("double").alias("altitude_m"))
    gas = lambda o2, he=None: F.struct(F.lit(o2).alias("o2"), F.lit(he).cast("double").alias("he"))
    first = F.when(k % 3 == 0, gas(0.21)).when(k % 3 == 1, gas(0.32)).otherwise(gas(0.18, 0.45))
    gases = F.when(k % 4 != 0, F.when(k % 6 == 1, F.array(first, gas(0.5))).otherwise(F.array(first)))
    series = F.when(k % 2 == 1, F.struct(F.array(F.lit(0.0), F.lit(10.0)).alias("time_s"), F.array(F.lit(0.0), number(c % 30)).alias("depth_m"), F.array(F.lit(None).cast("double"), number(c % 20)).alias("temp_c")))
    dives = read(spark, d, "orders").join(read(spark, d, "customer"), c == F.col("c_custkey"))
    return dives.select(
        F.col("c_nationkey").alias("owner"), k.alias("id"), (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=k % 86_400)).alias("start_local"), F.when(k % 5 != 0, ((k % 25) * 60 - 720).cast("int")).alias("offset_minutes"),
        F.when(k % 7 != 0, site).alias("site"), gases.alias("gases"), number(c % 400).alias("max_depth_m"), F.lit(None).cast("double").alias("avg_depth_m"), (c % 1500 * 60).alias("duration_s"), number(c % 40).alias("water_temp_c"), number(c % 5).alias("weight_kg"), series.alias("series"),
    )


DIVES = """
o AS (SELECT c_nationkey AS owner, o_orderkey AS k, o_custkey AS c, o_orderdate::TIMESTAMP + to_seconds((o_orderkey % 86400)::DOUBLE) AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"""
WITH {DIVES}
SELECT owner, n, 'dive_' || n::VARCHAR AS ref, CASE WHEN k % 7 <> 0 AND c % 10 <> 0 THEN 'Site & ' || (c % 40)::VARCHAR END AS site, CASE WHEN k % 7 <> 0 THEN (c % 40)::DOUBLE END AS lat, CASE WHEN k % 7 <> 0 THEN (-(c % 40) * 2)::DOUBLE END AS lon,
  CASE WHEN k % 4 <> 0 AND k % 2 = 1 THEN CASE k % 3 WHEN 0 THEN '0.21' WHEN 1 THEN '0.32' ELSE '0.18+0.45' END ELSE '' END AS gases, strftime(t, '%Y-%m-%d %H:%M:%S') AS started, CASE WHEN k % 5 <> 0 THEN ((k % 25) * 60 - 720)::INT END AS offset_minutes,
  CASE WHEN c % 400 <= 350 THEN (c % 400)::DOUBLE END AS max_depth_m, CASE WHEN c % 1500 * 60 <= 86400 THEN (c % 1500 * 60)::DOUBLE END AS duration_s, round((c % 40)::DOUBLE, 4) AS water_temp_c, CASE WHEN c % 5 <> 0 THEN (c % 5)::DOUBLE END AS weight_kg,
  CASE WHEN k % 2 = 1 THEN '0,' || (c % 30)::VARCHAR END AS depths, CASE WHEN k % 2 = 1 THEN (c % 20)::VARCHAR || ',' || (c % 20)::VARCHAR END AS temps,
  concat_ws(',', CASE WHEN c % 5 = 0 THEN 'sentinel' END, CASE WHEN c % 400 > 350 THEN 'out_of_range' END, CASE WHEN c % 1500 * 60 > 86400 THEN 'out_of_range' END) AS codes FROM o""")
def import_documents(spark: SparkSession, d: str) -> DataFrame:
    """Logbooks written as one document each, in which all use the same ids, and read back with sites, mixes and series."""
    path = f"{folder(spark)}/documents-{uuid.uuid4().hex}"
    exports.write_documents(exports.documents(_logbooks(spark, d), "owner", ["id"], MADE), path)
    got = documents.dive_observations(documents.read_documents(spark, path))
    gas = F.transform("gases", lambda g: F.concat(g["o2"].cast("string"), F.coalesce(F.concat(F.lit("+"), g["he"].cast("string")), F.lit(""))))
    whole = lambda c: F.array_join(F.transform(c, lambda x: F.round(x).cast("long").cast("string")), ",")
    return got.select(
        F.regexp_extract("file", r"owner=([^/]+)", 1).cast("int").alias("owner"), (F.col("at") + 1).cast("long").alias("n"), F.col("source_ref").alias("ref"), F.col("site.name").alias("site"), "site.lat", "site.lon", F.array_join(gas, ",").alias("gases"),
        F.col("start_local").cast("string").alias("started"), "offset_minutes", "max_depth_m", "duration_s", F.round("water_temp_c", 4).alias("water_temp_c"), "weight_kg", whole("series.depth_m").alias("depths"), whole("series.temp_c").alias("temps"),
        F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"),
    )


@query(f"""
WITH {DIVES},
s AS (SELECT owner, n, CASE WHEN c % 10 <> 0 THEN 'Site &amp; ' || (c % 40)::VARCHAR END AS name, c % 40 AS m FROM o WHERE k % 7 <> 0),
s1 AS (SELECT owner, m, any_value(name) AS name, min(n) AS n FROM s GROUP BY owner, m), s2 AS (SELECT *, 'site_' || row_number() OVER (PARTITION BY owner ORDER BY n)::VARCHAR AS id FROM s1),
g AS (SELECT owner, n, 0 AS i, CASE k % 3 WHEN 0 THEN '<name>air</name><o2>0.21</o2>' WHEN 1 THEN '<name>ean32</name><o2>0.32</o2>' ELSE '<name>ean18</name><o2>0.18</o2><he>0.45</he>' END AS body FROM o WHERE k % 4 <> 0
  UNION ALL SELECT owner, n, 1, '<name>ean50</name><o2>0.5</o2>' FROM o WHERE k % 4 <> 0 AND k % 6 = 1),
g1 AS (SELECT owner, body, min((n, i)) AS spot FROM g GROUP BY owner, body), g2 AS (SELECT *, 'mix_' || row_number() OVER (PARTITION BY owner ORDER BY spot)::VARCHAR AS id FROM g1)
SELECT owner::VARCHAR AS owner, 'site' AS part, '<site id="' || id || '"><name>' || coalesce(name, id) || '</name><geography><latitude>' || m::VARCHAR || '</latitude><longitude>' || (-m * 2)::VARCHAR || '</longitude></geography></site>' AS line FROM s2
UNION ALL SELECT owner::VARCHAR, 'mix', '<mix id="' || id || '">' || body || '</mix>' FROM g2
UNION ALL SELECT owner::VARCHAR, 'frame', unnest(['<?xml version="1.0" encoding="UTF-8"?>|<uddf version="3.2.0" xmlns="http://www.streit.cc/uddf/3.2/">|<generator><name>logweave</name><datetime>{MADE}</datetime></generator>', '<divesite>', '</divesite>', '<gasdefinitions>', '</gasdefinitions>', '<profiledata>', '</profiledata>|</uddf>']) FROM (SELECT DISTINCT owner FROM o)
UNION ALL SELECT o.owner::VARCHAR, 'dive', '<repetitiongroup><dive id="dive_' || o.n::VARCHAR || '"><informationbeforedive>' || coalesce('<link ref="' || s2.id || '"/>', '') || '<datetime>' || strftime(t, '%Y-%m-%dT%H:%M:%S.000')
  || CASE WHEN k % 5 = 0 THEN '' ELSE CASE WHEN k % 25 < 12 THEN '-' ELSE '+' END || lpad(abs(k % 25 - 12)::VARCHAR, 2, '0') || ':00' END || '</datetime></informationbeforedive>|'
  || CASE WHEN k % 2 = 1 THEN '<samples><waypoint><divetime>0</divetime><depth>0</depth><switchmix ref="' || g2.id || '"/></waypoint>|<waypoint><divetime>10</divetime><depth>' || (c % 30)::VARCHAR || '</depth><temperature>' || (c % 20 + 273)::VARCHAR || '.15</temperature></waypoint></samples>|' ELSE '' END
  || '<informationafterdive><lowesttemperature>' || (c % 40 + 273)::VARCHAR || '.15</lowesttemperature><greatestdepth>' || (c % 400)::VARCHAR || '</greatestdepth><diveduration>' || (c % 1500 * 60)::VARCHAR || '</diveduration><equipmentused><leadquantity>' || (c % 5)::VARCHAR || '</leadquantity></equipmentused></informationafterdive></dive></repetitiongroup>'
  FROM o LEFT JOIN s2 ON s2.owner = o.owner AND s2.m = c % 40 AND k % 7 <> 0 LEFT JOIN g ON g.owner = o.owner AND g.n = o.n AND g.i = 0 LEFT JOIN g2 ON g2.owner = o.owner AND g2.body = g.body""")
def export_documents(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the same documents, dictionaries and references included."""
    lines = exports.documents(_logbooks(spark, d), "owner", ["id"], MADE)
    part = F.when(F.col("section") == 2, "site").when(F.col("section") == 5, "mix").when(F.col("section") == 8, "dive").otherwise("frame")
    return lines.select("owner", part.alias("part"), F.replace("line", F.lit("\n"), F.lit("|")).alias("line"))


@query("""
WITH o AS (SELECT c_nationkey AS owner, o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT owner, n, CASE WHEN k % 3 <> 0 THEN 'dive ' || k::VARCHAR WHEN k % 2 = 0 THEN 'src ' || k::VARCHAR END AS ref, (c % 50)::DOUBLE AS max_depth_m, CASE WHEN k % 5 <> 0 THEN 'Site "' || (c % 9)::VARCHAR || '"' END AS site, 'Shore,Night' AS tags FROM o""")
def import_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Logbooks written as one JSON document each and read back; dives without an id of their own take their source's."""
    path, k, c = f"{folder(spark)}/json-{uuid.uuid4().hex}", F.col("o_orderkey"), F.col("o_custkey")
    source = lambda ref: F.struct(F.lit("csv").alias("sourceKind"), ref.alias("sourceRef"))
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), c == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("owner"), k.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("dive "), k.cast("string"))).alias("ref"), (c % 50).cast("double").alias("maxDepthM"), F.when(k % 5 != 0, F.struct(F.concat(F.lit('Site "'), (c % 9).cast("string"), F.lit('"')).alias("name"))).alias("site"),
        F.array(F.lit("Shore"), F.lit("Night")).alias("tags"), F.array(source(F.lit(None).cast("string")), source(F.when(k % 2 == 0, F.concat(F.lit("src "), k.cast("string"))))).alias("sources"),
    )
    exports.write_documents(exports.json_logbooks(rows, "owner", ["id"], ["ref", "maxDepthM", "site", "tags", "sources"], "logbook/1"), path)
    dives = files.read_json_logbooks(spark, path, "logbook/1")[1]
    return dives.select(F.regexp_extract("file", r"owner=([^/]+)", 1).cast("int").alias("owner"), (F.col("at") + 1).cast("long").alias("n"), F.col("source_ref").alias("ref"), F.col("dive.maxDepthM").alias("max_depth_m"), F.col("dive.site.name").alias("site"), F.array_join("dive.tags", ",").alias("tags"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN '0.32,' WHEN 1 THEN '0.18+0.45,0.5' ELSE NULL END AS gases FROM events")
def import_gases(spark: SparkSession, d: str) -> DataFrame:
    """Gas lists as they came: quoted numbers, entries that are no objects and texts that are no lists are no gases."""
    texts = ['[{"o2Fraction": 0.32}, {"o2Fraction": "0.5"}, 3, null, "x", {"o2Fraction": true}]', '[{"o2Fraction": 0.18, "heFraction": 0.45}, {"o2Fraction": 0.5, "heFraction": "0"}]', "[]", '{"o2Fraction": 0.21}', "[", '[{"heFraction": 1}]']
    text = F.get(F.array(*map(F.lit, texts)), (F.col("event_id") % 6).cast("int"))
    found = gases_of(text)
    one = F.transform(found, lambda g: F.concat(g["o2"].cast("string"), F.coalesce(F.concat(F.lit("+"), g["he"].cast("string")), F.lit(""))))
    joined = F.array_join(one, ",")
    return read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 6 == 0, F.concat(joined, F.lit(","))).otherwise(joined).alias("gases"))
