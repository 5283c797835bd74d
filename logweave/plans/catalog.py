"""The registered queries of the library's own operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import offsets, series, units
from logweave.functions.text import clean_number, name_similarity, no_null_tokens, slug
from logweave.operators import cleaning, merging, profile, search, stats, taxonomy
from logweave.operators.linking import nearest
from logweave.plans.registry import ORACLE_SQL, QUERIES, query
from logweave.sources.tables import read

def orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders")


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events")


@query("SELECT o_custkey, count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(o_totalprice) AS largest, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_custkey")
def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.totals(orders(spark, d), ["o_custkey"], "o_totalprice")


@query("""
WITH g AS (SELECT year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
     y AS (SELECT unnest(generate_series((SELECT min(year) FROM g), (SELECT max(year) FROM g))) AS year)
SELECT y.year AS year, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM y LEFT JOIN g ON y.year = g.year""")
def stats_overview_by_year(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_period(orders(spark, d), F.year("o_orderdate"), "o_totalprice", "year")


@query("""
WITH g AS (SELECT month(ts) AS month, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1),
     m AS (SELECT unnest(generate_series(1, 12)) AS month)
SELECT m.month AS month, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM m LEFT JOIN g ON m.month = g.month""")
def stats_month_of_year(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_period(events(spark, d), F.month("ts"), "value", "month", (1, 12))


@query("""
WITH g AS (SELECT floor(value / 50)::BIGINT AS bucket, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1),
     b AS (SELECT unnest(generate_series(0, (SELECT max(bucket) FROM g))) AS bucket)
SELECT b.bucket AS bucket, b.bucket * 50.0::DOUBLE AS from_value, coalesce(n, 0) AS n FROM b LEFT JOIN g ON b.bucket = g.bucket""")
def stats_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(events(spark, d), "value", 50.0)


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def window_numbering(spark: SparkSession, d: str) -> DataFrame:
    return stats.numbering(orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "number")


@query("""
WITH a AS (SELECT event_id, user_id, ts, value, epoch_us(ts) / 1e6 AS s, CAST(ts AS DATE) AS day FROM events),
     b AS (SELECT *, round(s - (lag(s) OVER w + lag(value) OVER w)) AS gap, CASE WHEN day = lag(day) OVER w THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)
SELECT event_id, user_id, CASE WHEN gap >= 0 THEN gap::BIGINT END AS interval_s, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS repetition FROM c""")
def window_intervals(spark: SparkSession, d: str) -> DataFrame:
    return stats.intervals(events(spark, d), "user_id", "ts", "event_id", "value").select("event_id", "user_id", "interval_s", "repetition")


@query("""
WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
     b AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM a),
     c AS (SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM b GROUP BY user_id, island),
     r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, first_day) AS k FROM c)
SELECT user_id, first_day, last_day, days FROM r WHERE k = 1""")
def window_streaks(spark: SparkSession, d: str) -> DataFrame:
    return stats.streaks(events(spark, d), "user_id", "ts")


@query("""
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
     b AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 1 THEN 0 ELSE 1 END AS split FROM a WINDOW w AS (PARTITION BY user_id ORDER BY day)),
     c AS (SELECT *, sum(split) OVER (PARTITION BY user_id ORDER BY day) AS trip FROM b)
SELECT user_id, min(day) AS first_day, max(day) AS last_day, sum(n)::BIGINT AS n FROM c GROUP BY user_id, trip HAVING sum(n) >= 3""")
def window_trips(spark: SparkSession, d: str) -> DataFrame:
    return stats.trips(events(spark, d), "user_id", "ts", 1)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, event_type AS common, n FROM r WHERE k = 1""")
def stats_mode(spark: SparkSession, d: str) -> DataFrame:
    return stats.mode(events(spark, d), "user_id", "event_type")


@query("SELECT o_custkey, o_orderkey % 10 AS number, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def stats_repeated_numbers(spark: SparkSession, d: str) -> DataFrame:
    return stats.repeated_numbers(orders(spark, d), "o_custkey", F.col("o_orderkey") % 10)


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def search_all_tags(spark: SparkSession, d: str) -> DataFrame:
    return search.having_all(events(spark, d), "user_id", "event_type", ["click", "purchase", "error"])


@query("SELECT event_type, count(*) AS n, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def search_facets(spark: SparkSession, d: str) -> DataFrame:
    return search.facets(events(spark, d), "event_type", "ts", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def search_first_page(spark: SparkSession, d: str) -> DataFrame:
    return search.page(orders(spark, d).select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 100) OR o_totalprice IS NULL ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def search_next_page(spark: SparkSession, d: str) -> DataFrame:
    return search.page(orders(spark, d).select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", after=(200000.0, 100))


CLEAN = """c AS (SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""


@query(f"WITH {CLEAN} SELECT event_id, CASE WHEN k BETWEEN 10 AND 90 THEN k END AS k, CASE WHEN k NOT BETWEEN 10 AND 90 THEN 1 ELSE 0 END AS n_issues FROM c")
def clean_range(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("event_id", "k", F.size("issues").alias("n_issues"))


@query(f"WITH {CLEAN} SELECT 'out_of_range' AS code, 'k' AS field, count(*) AS n, count(DISTINCT event_type) AS kinds, min(event_id) AS first_key FROM c WHERE k NOT BETWEEN 10 AND 90")
def clean_issue_rollup(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.issue_rollup(_cleaned(spark, d), "event_type", "event_id")


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    k = clean_number(no_null_tokens(F.get_json_object("props", "$.k")))
    return cleaning.in_range(events(spark, d).select("event_id", "event_type", k.alias("k")), "k", 10, 90)


@query("""
WITH a AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
SELECT event_id, user_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM a""")
def clean_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return cleaning.fill(rows, "user_id", "event_id", "v").drop("v")


@query("SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def text_slug(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"))


PLACE = "(({k} * 37) % 1000) / 100.0::DOUBLE + 40 AS lat, (({k} * 91) % 1000) / 100.0::DOUBLE + 5 AS lon"


@query(f"""
WITH a AS (SELECT c_custkey AS point_id, {PLACE.format(k="c_custkey")} FROM customer), b AS (SELECT s_suppkey AS place_id, {PLACE.format(k="s_suppkey")} FROM supplier),
m AS (SELECT point_id, place_id, round(2 * 6371008.8::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS m FROM a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY m, place_id) AS k FROM m WHERE m <= 50000)
SELECT point_id, place_id, m AS distance_m FROM r WHERE k = 1""")
def link_nearest(spark: SparkSession, d: str) -> DataFrame:
    place = lambda t, key, name: read(spark, d, t).select(F.col(key).alias(name), ((F.col(key) * 37 % 1000) / 100.0 + 40).alias("lat"), ((F.col(key) * 91 % 1000) / 100.0 + 5).alias("lon"))
    return nearest(place("customer", "c_custkey", "point_id"), place("supplier", "s_suppkey", "place_id"), 50_000)


ASSERTED = """
a AS (SELECT o_orderkey AS record, 'amount' AS field, o_totalprice AS value, 1 AS rank, o_orderdate AS recorded_at, 'order' AS source FROM orders
  UNION ALL SELECT l_orderkey, 'amount', l_extendedprice, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END, l_shipdate, 'line' || l_linenumber::VARCHAR FROM lineitem)"""
RESOLVED = """
v AS (SELECT *, row_number() OVER (PARTITION BY record, field ORDER BY rank, recorded_at DESC, source, value) AS k, count(*) OVER (PARTITION BY record, field) AS n_sources FROM {a} WHERE value IS NOT NULL),
x AS (SELECT record, field, rank, min(value) AS low, max(value) AS high FROM v GROUP BY 1, 2, 3)
SELECT v.record AS record, v.field AS field, v.value AS value, v.source AS source, n_sources, greatest(high - v.value, v.value - low) > 1e-9 AS contested
FROM v JOIN x ON v.record = x.record AND v.field = x.field AND v.rank = x.rank WHERE k = 1"""


def _asserted(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select(F.col("o_orderkey").alias("record"), F.lit("amount").alias("field"), F.col("o_totalprice").alias("value"), F.lit(1).alias("rank"), F.col("o_orderdate").alias("recorded_at"), F.lit("order").alias("source"))
    rank = F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(1)
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), F.lit("amount").alias("field"), F.col("l_extendedprice").alias("value"), rank.alias("rank"), F.col("l_shipdate").alias("recorded_at"), F.concat(F.lit("line"), F.col("l_linenumber")).alias("source"))
    return o.unionByName(line)


@query(f"WITH {ASSERTED}, {RESOLVED.format(a='a')}")
def merge_resolve(spark: SparkSession, d: str) -> DataFrame:
    return merging.resolve(_asserted(spark, d))


@query(f"WITH {ASSERTED}, w AS (SELECT * FROM a WHERE source NOT IN ('line2', 'order')), {RESOLVED.format(a='w')}")
def merge_revert(spark: SparkSession, d: str) -> DataFrame:
    return merging.revert(_asserted(spark, d), spark.createDataFrame([("line2",), ("order",)], "source string"))


@query("""
WITH f AS (SELECT conv_id, lower(trim(role)) AS form, min(turn) AS o FROM conversations WHERE trim(role) <> '' GROUP BY 1, 2),
     s AS (SELECT f.conv_id, f.o, min(trim(c.role)) AS v FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.o AND lower(trim(c.role)) = f.form GROUP BY f.conv_id, f.o, f.form)
SELECT conv_id, string_agg(v, ',' ORDER BY o, v) AS merged, count(*) AS n FROM s GROUP BY conv_id""")
def merge_union(spark: SparkSession, d: str) -> DataFrame:
    return merging.union_values(read(spark, d, "conversations"), "conv_id", "turn", "role")


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderkey % 10 AS w, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 10 ORDER BY o_orderdate, o_orderkey) AS c FROM orders),
     b AS (SELECT *, CASE WHEN w >= 1 AND c = 1 THEN w END AS kept FROM a)
SELECT o_orderkey, o_custkey, coalesce(kept, coalesce(max(kept) OVER (PARTITION BY o_custkey), 0) + row_number() OVER (PARTITION BY o_custkey, kept IS NULL ORDER BY o_orderdate, o_orderkey)) AS number FROM b""")
def merge_claim_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).withColumn("wanted", F.col("o_orderkey") % 10)
    return merging.claim_numbers(rows, "o_custkey", "o_orderdate", "o_orderkey", "wanted").select("o_orderkey", "o_custkey", "number")


@query("""
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
     r AS (SELECT *, (lag(v) OVER (PARTITION BY vec_id ORDER BY i) - v) / 15 * 60 AS rise FROM e)
SELECT vec_id, count(*) AS n, ((count(*) - 1) * 15)::BIGINT AS seconds, round(max(v), 5) AS most, round(min(v), 5) AS least, round(avg(v), 5) AS mean, round(greatest(max(rise), 0), 4) AS fastest_rise FROM r GROUP BY vec_id""")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.summary(read(spark, d, "embeddings"), "vec_id", "embedding")


TIMES = """
e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id % 10 <> 0),
t AS (SELECT vec_id, i, v, (i * 10 + (i + vec_id) % 3 * CASE WHEN i % 5 = 0 THEN -8 ELSE 4 END)::DOUBLE AS s FROM e),
r AS (SELECT *, lag(v) OVER w - v AS up, s - lag(s) OVER w AS dt FROM t WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT vec_id, count(*) AS n, arg_max(s, i) - arg_min(s, i) AS duration_s, max(v) AS most, avg(v) AS mean, max(CASE WHEN dt > 0 AND up > 0 THEN up / dt * 60 END) AS rise, min(v) AS low FROM r GROUP BY vec_id)"""


@query(f"""
WITH {TIMES}
SELECT e.vec_id AS vec_id, coalesce(n, 0) AS n, coalesce(duration_s, 0) AS duration_s, round(coalesce(most, 0), 5) AS max_depth_m, round(coalesce(mean, 0), 5) AS avg_depth_m, CASE WHEN n > 1 THEN round(coalesce(rise, 0), 4) END AS max_ascent_m_per_min, CASE WHEN n > 1 THEN floor(duration_s / (n - 1) + 0.5)::BIGINT END AS interval_s,
  CASE WHEN e.vec_id % 4 = 0 THEN round(low, 5) END AS min_temp_c, CASE WHEN e.vec_id % 4 = 0 THEN round(most, 5) END AS max_temp_c, CASE WHEN e.vec_id % 10 = 0 THEN '' WHEN e.vec_id % 4 = 0 THEN 'time,depth,temp' ELSE 'time,depth' END AS channels FROM embeddings e LEFT JOIN g ON g.vec_id = e.vec_id""")
def profile_timed_summary(spark: SparkSession, d: str) -> DataFrame:
    """Series with times of their own: gaps, samples at one time and backwards; some without any channel."""
    there = F.col("vec_id") % 10 != 0
    times = F.transform("embedding", lambda _, k: ((k + 1) * 10 + (k + 1 + F.col("vec_id")) % 3 * F.when((k + 1) % 5 == 0, -8).otherwise(4)).cast("double"))
    rows = read(spark, d, "embeddings").select("vec_id", F.when(there, times).alias("t"), F.when(there, F.col("embedding")).alias("v"), F.when(there & (F.col("vec_id") % 4 == 0), F.col("embedding")).alias("c"))
    four = {"max_ascent_m_per_min": 4, "max_depth_m": 5, "avg_depth_m": 5, "min_temp_c": 5, "max_temp_c": 5}
    return profile.timed_summary(rows, "vec_id", "t", "v", "c").withColumns({n: F.round(n, k) for n, k in four.items()})


@query("""
WITH e AS (SELECT vec_id, len(embedding) AS n, list_position(embedding, list_max(embedding)) - 1 AS top, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings)
SELECT vec_id, i, round(v::DOUBLE, 5) + 0.0::DOUBLE AS v FROM e WHERE i % greatest(1, n // 12) = 0 OR i = n - 1 OR i = top""")
def profile_thin(spark: SparkSession, d: str) -> DataFrame:
    return profile.thin(read(spark, d, "embeddings"), "vec_id", "embedding")


@query("""
SELECT event_id, round(value * 0.3048::DOUBLE, 6) AS metres, round((value - 32) * 5 / 9, 6) AS celsius, round(value * 0.45359237::DOUBLE, 6) AS kilograms, round(value * 6894.757293168361::DOUBLE / 100000, 6) AS bar,
       round(value * 28.316846592::DOUBLE, 6) AS litres, DATE '1899-12-30' + (event_id % 99998 + 2)::INTEGER AS day, floor((event_id % 1000) / 1000.0::DOUBLE * 86400 + 0.5)::BIGINT AS seconds FROM events""")
def units_converted(spark: SparkSession, d: str) -> DataFrame:
    v, key = F.col("value"), F.col("event_id")
    return events(spark, d).select(
        "event_id",
        F.round(units.feet_to_metres(v), 6).alias("metres"),
        F.round(units.fahrenheit_to_celsius(v), 6).alias("celsius"),
        F.round(units.pounds_to_kilograms(v), 6).alias("kilograms"),
        F.round(units.psi_to_bar(v), 6).alias("bar"),
        F.round(units.cubic_feet_to_litres(v), 6).alias("litres"),
        units.serial_to_date(key % 99_998 + 2 + F.lit(0.25)).alias("day"),
        units.fraction_to_seconds(key % 1000 / 1000.0).alias("seconds"),
    )


MILESTONE = "SELECT *, (floor(n / step) + 1)::BIGINT * step AS milestone FROM (SELECT *, CASE WHEN n < 100 THEN 25 WHEN n < 500 THEN 50 ELSE 100 END AS step FROM c)"


@query(f"WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n, milestone FROM ({MILESTONE})")
def stats_milestones(spark: SparkSession, d: str) -> DataFrame:
    counted = orders(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("milestone", units.next_milestone(F.col("n")))


@query(f"WITH c AS (SELECT o_custkey % k AS club, k AS clubs, count(*) AS n FROM orders, (VALUES (200), (40), (8)) v(k) GROUP BY 1, 2) SELECT club, clubs, n, milestone FROM ({MILESTONE})")
def stats_club_milestones(spark: SparkSession, d: str) -> DataFrame:
    clubs = orders(spark, d).select("o_custkey", F.explode(F.array(F.lit(200), F.lit(40), F.lit(8))).alias("clubs"))
    counted = clubs.groupBy((F.col("o_custkey") % F.col("clubs")).alias("club"), "clubs").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("milestone", units.next_milestone(F.col("n")))


@query("""
WITH a AS (SELECT event_id, (event_id % 1441 - 720)::INTEGER AS m, CASE WHEN event_id % 3 = 0 THEN (event_id % 1441 - 720) * 60 WHEN event_id % 3 = 1 THEN 0 END AS place FROM events),
     b AS (SELECT *, abs(m) < 60 AND m % 60 <> 0 AS wrong, coalesce(place = m * 60, false) AS fits FROM a)
SELECT event_id, CASE WHEN wrong AND fits THEN m * 60 ELSE m END AS offset_minutes, wrong AND NOT fits AS suspect, CASE WHEN wrong AND fits THEN 'high' WHEN wrong THEN 'low' END AS confidence,
       (CASE WHEN m < 0 THEN '-' ELSE '+' END) || lpad((abs(m) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(m) % 60)::VARCHAR, 2, '0') AS written FROM b""")
def clean_offsets(spark: SparkSession, d: str) -> DataFrame:
    m = (F.col("event_id") % 1441 - 720).cast("int")
    place = F.when(F.col("event_id") % 3 == 0, m * 60).when(F.col("event_id") % 3 == 1, 0)
    return events(spark, d).select("event_id", offsets.repaired(m, place).alias("r"), offsets.formatted(m).alias("written")).select("event_id", F.col("r.offset").alias("offset_minutes"), "r.suspect", "r.confidence", "written")


@query("""
WITH a AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS x, trim(regexp_replace(lower(CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_brand ELSE p_type END), '[^a-z0-9]+', '-', 'g'), '-') AS y FROM part)
SELECT p_partkey, round(CASE WHEN x = '' OR y = '' THEN 0::DOUBLE WHEN x = y THEN 1::DOUBLE WHEN contains(x, y) OR contains(y, x) THEN 0.8::DOUBLE + 0.15::DOUBLE * (least(length(x), length(y)) / greatest(length(x), length(y))::DOUBLE)
  ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE END, 6) AS score FROM a""")
def text_name_similarity(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", F.round(name_similarity(F.col("p_name"), other), 6).alias("score"))


KINDS = [("click", "Click", ["tap", "press"]), ("purchase", "Purchase", ["buy"]), ("view", "View", []), ("error", "Error", ["Fault!"])]


@query("""
WITH t(place, entry, label) AS (VALUES (0, 'click', 'Click'), (1, 'purchase', 'Purchase'), (2, 'view', 'View'), (3, 'error', 'Error')),
     al(place, form) AS (VALUES (0, 'tap'), (0, 'press'), (1, 'buy'), (3, 'fault')),
     i AS (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || 's' WHEN 2 THEN 'Fault' ELSE event_type || ' other' END AS input FROM events),
     s AS (SELECT input, trim(regexp_replace(lower(input), '[^a-z0-9]+', '-', 'g'), '-') AS own FROM i),
     m AS (SELECT input, 0 AS o, NULL::INTEGER AS distance, place, 'exact' AS kind FROM s JOIN t ON own = entry
           UNION ALL SELECT input, 1, NULL, place, 'alias' FROM s JOIN al ON own = form
           UNION ALL SELECT input, 2, levenshtein(own, entry)::INTEGER, place, 'fuzzy' FROM s JOIN t ON own <> entry AND levenshtein(own, entry) <= CASE WHEN length(own) <= 3 THEN 0 WHEN length(own) <= 6 THEN 1 ELSE 2 END),
     r AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY o, distance, place) AS k FROM m)
SELECT s.input AS input, coalesce(r.kind, 'new') AS kind, coalesce(t.entry, s.own) AS slug, coalesce(t.label, trim(s.input)) AS label, r.distance AS distance
FROM s LEFT JOIN r ON s.input = r.input AND r.k = 1 LEFT JOIN t ON r.place = t.place""")
def link_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    kind, key = F.col("event_type"), F.col("event_id") % 4
    tag = F.when(key == 0, kind).when(key == 1, F.concat(kind, F.lit("s"))).when(key == 2, "Fault").otherwise(F.concat(kind, F.lit(" other")))
    return taxonomy.match(events(spark, d).select(tag.alias("tag")), "tag", KINDS)


@query("""
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, floor(unnest(embedding)::DOUBLE * 1000 + 0.5)::BIGINT AS w FROM embeddings),
     g AS (SELECT vec_id, w, w - coalesce(lag(w) OVER (PARTITION BY vec_id ORDER BY i), 0) AS dif FROM e),
     z AS (SELECT vec_id, w, CASE WHEN dif < 0 THEN -2 * dif - 1 ELSE 2 * dif END AS v FROM g)
SELECT vec_id, (6 + 1 + sum(1 + (v >= 128)::INTEGER + (v >= 16384)::INTEGER + (v >= 2097152)::INTEGER))::BIGINT AS n_bytes, round(sum(w) / 1000.0::DOUBLE, 3) AS total, round(max(w) / 1000.0::DOUBLE, 3) AS most FROM z GROUP BY vec_id""")
def profile_codec(spark: SparkSession, d: str) -> DataFrame:
    blobs = read(spark, d, "embeddings").select("vec_id", series.encode({"depthM": F.col("embedding")}).alias("blob"))
    back = blobs.select("vec_id", F.length("blob").cast("long").alias("n_bytes"), series.decode(F.col("blob"), "depthM").alias("back"))
    return back.select("vec_id", "n_bytes", F.round(F.aggregate("back", F.lit(0.0), lambda a, v: a + v), 3).alias("total"), F.round(F.array_max("back"), 3).alias("most"))


CUTS = """
c AS (SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN 'truncated' WHEN 1 THEN 'bad magic' WHEN 2 THEN 'unsupported version 2' WHEN 3 THEN 'varint too long' WHEN 4 THEN 'truncated' END AS damage FROM embeddings)"""


@query(f"WITH {CUTS} SELECT vec_id, damage, CASE WHEN damage IS NULL THEN 64 END::BIGINT AS n FROM c")
def profile_damage(spark: SparkSession, d: str) -> DataFrame:
    """Blobs that end early, or whose head or a number is not as it must be, and sound ones with bytes after the end."""
    blob, k = F.col("blob"), F.col("vec_id") % 6
    blobs = read(spark, d, "embeddings").select("vec_id", series.encode({"depthM": F.col("embedding")}).alias("blob"))
    tail = F.substring(F.hex(blob), 13, 1 << 20)
    broken = F.when(k == 0, F.substring(F.hex(blob), 1, 100)).when(k == 1, F.concat(F.lit("00"), F.substring(F.hex(blob), 3, 1 << 20))).when(k == 2, F.concat(F.lit("4D444C3102"), F.substring(F.hex(blob), 11, 1 << 20)))
    broken = broken.when(k == 3, F.concat(F.substring(F.hex(blob), 1, 12), F.lit("FFFFFFFFFFFF01"), tail)).when(k == 4, F.lit("4D44")).otherwise(F.concat(F.hex(blob), F.lit("FF00")))
    back = blobs.select("vec_id", F.unhex(broken).alias("blob"))
    return back.select("vec_id", series.damage(F.col("blob")).alias("damage"), F.size(series.decode(F.col("blob"), "depthM")).alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")).cast("long"))


# the modules below add their queries to the same registry
from logweave.plans import documents, imports, linking, logbook, records, relations  # noqa: E402, F401
