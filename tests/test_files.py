"""Files: delimited sheets, XML logs, JSON entries, exports read back."""

from pyspark.sql import functions as F

from logweave.functions import parsing
from logweave.operators import sheets
from logweave.sources import exports, files


def test_delimiters():
    assert [files.delimiter(x) for x in ("a,b;c,d", "a;b;c", "a\tb", '"a,b,c";d;e', "one", "a|b|c,d")] == [",", ";", "\t", ";", ",", "|"]


def test_sheet_with_quotes_blank_and_ragged_rows(spark, tmp_path):
    (tmp_path / "log.csv").write_text('﻿Dive #; Date ;Notes\n1;2024-01-02;"a ""b""; c\nnext line"\n;;\n2;2024-01-03\n3;2024-01-04;x;too;many\n', encoding="utf-8")
    df = files.read_delimited(spark, str(tmp_path / "log.csv"))
    assert df.columns == ["Dive #", "Date", "Notes", "_ragged"]
    rows = {r["Dive #"]: r for r in df.collect()}
    assert rows["1"].Notes == 'a "b"; c\nnext line' and rows["1"]._ragged is None and set(rows) == {"1", "2", "3"}
    assert rows["2"].Notes is None and rows["3"]._ragged is not None
    (tmp_path / "empty.csv").write_text("")
    assert files.read_delimited(spark, str(tmp_path / "empty.csv")).count() == 0


def test_guess_takes_each_field_once():
    found, left = sheets.guess(["Dive No", "Number", "Max Depth (ft)", "Depth metres", "Water Temperature (F)", "Air temp C", "Dive Site", "Site", "Éan", "Whatever"])
    assert found["Dive No"] == "diveNumber" and found["Max Depth (ft)"] == "maxDepthFt" and found["Depth metres"] == "maxDepthM" and found["Water Temperature (F)"] == "waterTempF"
    assert found["Dive Site"] == "siteName" and found["Éan"] == "eanPercent" and {"Site", "Whatever"} <= set(left) and len(set(found.values())) == len(found)


def test_observations_of_empty_cells(spark):
    rows = spark.createDataFrame([(None, "n/a", "-"), ("", "25:00", "7"), ("2024-03-01", "9:30 pm", "400"), ("2024-03-01", "9:30 pm", "400")], "`Date` string, `Time In` string, `Depth m` string")
    mapping, _ = sheets.guess(rows.columns)
    got = sheets.observations(rows, mapping, []).select(F.col("start_local").cast("string"), "max_depth_m", F.transform("issues", lambda i: i["code"]).alias("codes")).collect()
    assert [tuple(r) for r in got] == [(None, None, ["missing_date"]), (None, 7.0, ["missing_date"]), ("2024-03-01 21:30:00", None, ["out_of_range"]), ("2024-03-01 21:30:00", None, ["out_of_range"])]
    assert sheets.observations(rows.limit(0), mapping, []).count() == 0


def test_times_and_lists(spark):
    cells = ["0:00", "12:00 am", "12:30 PM", "13:00 pm", "24:00", "9:60", "0.5", "1", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(parsing.seconds_of_day(F.col("c"))).collect()] == [0, 0, 45_000, None, None, None, 43_200, None, None, None]
    texts = ["a, b;c", '"1,000 Steps", x', "it's, one", "", None, "a||b", ' "" , z']
    df = spark.createDataFrame([(c,) for c in texts], "c string")
    assert [r[0] for r in df.select(parsing.split_list(F.col("c"))).collect()] == [["a", "b", "c"], ["1,000 Steps", "x"], ["its, one"], [], None, ["a", "b"], ["z"]]
    stamps = ["2024-01-02T03:04:05-04:00", "2024-01-02 03:04Z", "2024-01-02T10:75:00", "2024-02-30T00:00:00", "x", None]
    df = spark.createDataFrame([(c,) for c in stamps], "c string").select(parsing.wall_clock(F.col("c")).alias("w")).select(F.col("w.local").cast("string"), "w.offset_minutes")
    assert [tuple(r) for r in df.collect()] == [("2024-01-02 03:04:05", -240), ("2024-01-02 03:04:00", 0), ("2024-01-02 11:15:00", None), (None, None), (None, None), (None, None)]


def test_xml_log_of_a_file(spark, tmp_path):
    (tmp_path / "log.xml").write_text("""<?xml version="1.0"?><log>
<dive><id>a</id><datetime>2024-05-01T10:00:00+02:00</datetime><greatestdepth>12.5</greatestdepth><link ref="s1"/><link ref="m1"/><link ref="none"/><leadquantity>0.0</leadquantity>
<waypoint><divetime>0</divetime><depth>0</depth></waypoint><waypoint><divetime>15</divetime><depth>5</depth><temperature>20</temperature></waypoint><waypoint><depth>6</depth></waypoint></dive>
<dive><id>b</id></dive></log>""")
    dives = files.read_xml_log(spark, str(tmp_path / "log.xml"))
    sites, mixes = spark.createDataFrame([("s1",), ("s1",)], "id string"), spark.createDataFrame([("m1", 0.32)], "id string, o2 double")
    got = {r.id: r for r in files.dives_of_xml(dives, sites, mixes).collect()}
    assert (got["a"].site_id, got["a"].o2, got["a"].lead_kg, got["a"].n_points, got["a"].offset_minutes) == ("s1", 0.32, None, 3, 120) and got["b"].site_id is None
    series = {r.id: r.s for r in dives.select("id", files.waypoints_series(F.col("waypoint")).alias("s")).collect()}
    assert series["a"].depth_m == [0, 5] and series["a"].temp_c == [20, 20]


def test_exported_sheet_reads_back(spark, tmp_path):
    dives = spark.createDataFrame([(1, 10.12345, 'a "b", c'), (2, None, None), (3, 5.0, "")], "id int, depth double, notes string")
    rows = exports.sheet(dives.coalesce(1), "id", {"Number": ("id", None), "Depth": ("depth", "depth"), "Notes": ("notes", None)})
    exports.write_sheet(rows, str(tmp_path / "out"))
    back = {r["Number"]: r for r in files.read_delimited(spark, str(tmp_path / "out"), ",").collect()}
    assert back["1"]["Depth (m)"] == "10.1235" and back["1"].Notes == 'a "b", c' and back["2"]["Depth (m)"] is None and back["3"]["Depth (m)"] == "5"
