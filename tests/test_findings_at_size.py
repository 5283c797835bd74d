"""What only larger tables showed: chance agreements, many rows of one coordinate, few batches, one file for all."""

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from logweave.operators import linking, reverts
from logweave.plans import catalog, records

FOLDER = "/root/testdata/sf0.001"


def test_small_quantities_beside_large_prices_are_no_sum(spark, tmp_path):
    rows = [(k, n, float(n), 90_000.0 + 7 * n * k) for k in (1, 2) for n in (1, 2, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["audit_derived"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["audit_derived"](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr) and len(want) == 4


@pytest.mark.parametrize("name", ["link_similar_names", "link_all_similar_names"])
def test_names_from_a_similarity_of_six_tenths_on(spark, name):
    least = catalog.QUERIES[name](spark, FOLDER).agg(F.min("score")).first()[0]
    assert 0.6 <= least < 0.7


@pytest.fixture
def looked_up(monkeypatch):
    """How many points and places the join over cells was given."""
    sizes, near = [], linking.near

    def counted(points, places, *more):
        sizes.append((points.count(), places.count()))
        return near(points, places, *more)

    monkeypatch.setattr(linking, "near", counted)
    return sizes


def test_points_of_one_coordinate_are_looked_up_once(spark, looked_up):
    points = spark.range(500).selectExpr("id AS point_id", "CAST(id % 2 AS double) AS lat", "1d AS lon")
    places = spark.range(400).selectExpr("id + 7 AS place_id", "0d AS lat", "1d AS lon")
    got = linking.nearest(points, places, 1000).collect()
    assert looked_up == [(2, 1)] and sorted(tuple(r) for r in got) == [(i, 7, 0.0) for i in range(0, 500, 2)]


def test_sites_of_one_coordinate_and_name_are_looked_up_once(spark, looked_up):
    points = spark.range(600).selectExpr("1 AS owner", "id AS point_id", "IF(id % 3 = 0, 5d, NULL) AS lat", "IF(id % 3 = 0, 6d, NULL) AS lon", "IF(id % 3 = 1, 'Reef', NULL) AS name")
    sites = spark.range(300).selectExpr("1 AS owner", "id + 9 AS site_id", "5d AS lat", "6d AS lon", "'Reef' AS name", "array('x') AS aliases")
    got = sorted(tuple(r) for r in linking.site_matches(points, sites).collect())
    assert looked_up == [(3, 1)] and got == [(1, i, 9, ("coordinates", "name")[i % 3]) for i in range(600) if i % 3 < 2]


def test_sources_are_not_dealt_by_batch(spark):
    rows = [(1, 1, b, b, "uddf", None, None, 2.0) for b in range(4)]
    sources = spark.createDataFrame(rows, "owner int, record int, batch int, row int, kind string, source_ref string, recorded_at timestamp, max_depth_m double")
    before = spark.createDataFrame([(1, 1, None, None)], "owner int, record int, start_utc timestamp, start_local timestamp")
    got = reverts.reverted(before, sources, sources.select("batch").where("batch < 2"), {"max_depth_m": "maxDepthM"})
    assert "hashpartitioning(batch" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.outcome, r.max_depth_m) for r in got.collect()] == [("kept", 2.0)]


def test_a_sheet_is_written_by_all_tasks(spark, monkeypatch):
    found, read = [], records.files.read_delimited
    monkeypatch.setattr(records.files, "read_delimited", lambda s, path: found.extend(glob.glob(f"{path}/part-*")) or read(s, path))
    records.import_delimited(spark, FOLDER).count()
    assert len(found) > 1


def test_a_second_batch_may_repeat_numbers(spark, tmp_path):
    """Views a million numbers below a purchase, of another user."""
    rows = [(10, 1, "view", 50.0), (1_000_010, 2, "purchase", 70.0), (1_000_020, 3, "view", 9.0), (1_000_030, 3, "purchase", 9.0), (20, 4, "view", 9.0)]
    table = spark.createDataFrame([(i, u, t, v) for i, u, t, v in rows], "event_id long, user_id long, event_type string, value double")
    table.selectExpr("event_id", "timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, event_id % 7) AS ts", "user_id", "event_type", "value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, value, props FROM '{tmp_path}/events.parquet/*.parquet'")
    names = "owner, record, n_sources, start_local, max_depth_m, duration_s, site_name, gas"
    want = con.execute(f"SELECT {names} FROM ({catalog.ORACLE_SQL['link_batches']})").fetchall()
    got = catalog.QUERIES["link_batches"](spark, str(tmp_path)).selectExpr(*names.split(", ")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_dives_are_not_dealt_by_their_dictionaries(spark, monkeypatch):
    from logweave.sources import exports

    dives = spark.range(60).selectExpr(
        "cast(id % 3 as int) owner", "id", "timestamp_ntz'2020-01-01 10:00:00' start_local", "cast(60 as int) offset_minutes",
        "if(id % 7 = 0, null, named_struct('name', concat('s', id % 5), 'lat', 1d, 'lon', 2d, 'altitude_m', cast(null as double))) site",
        "if(id % 4 = 0, null, array(named_struct('o2', if(id % 2 = 0, 0.21d, 0.32d), 'he', cast(null as double)))) gases",
        "10d max_depth_m", "5d avg_depth_m", "60d duration_s", "20d water_temp_c", "2d weight_kg", "named_struct('time_s', array(0d), 'depth_m', array(1d), 'temp_c', array(9d)) series",
    )
    made = lambda: exports.documents(dives, "owner", ["id"], "now")
    lines = lambda df: sorted((r.owner, r.section, tuple(r.place), r.line) for r in df.collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = made()
        assert "SortMergeJoin" not in small._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(exports, "BROADCAST_BYTES", 0)
        large = made()
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert lines(small) == lines(large)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
