"""Whole XML documents: read with all their parts, written one for each owner, and read back."""

import datetime
import glob
import re

import pytest
from pyspark.sql import functions as F

from logweave.functions.gases import gases_of
from logweave.sources import documents, exports, files

WHOLE = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a log - with > odd - <marks> -->
<uddf version="3.2.0" xmlns="http://www.streit.cc/uddf/3.2/">
<tankdata id="t1"><link ref="air"/></tankdata>
<a><tankdata id="t2"><link ref="ean"/></tankdata><b><tankdata id="t3"><link ref="tri"/></tankdata><c><d><tankdata id="t4"><link ref="gone"/></tankdata><tankdata id="t5"/><tankdata><link ref="air"/></tankdata></d></c></b></a>
<divesite><site id="s1"><name> Blue &amp; Hole </name><geography><latitude>1.5</latitude><longitude>-2.25</longitude><altitude>9000</altitude></geography></site>
<site id="site_69ab00ff12"><name>site_69ab00ff12</name><geography><latitude>3</latitude><longitude>4</longitude></geography></site><site><name>no id</name></site><site id="s1"><name>Later</name></site></divesite>
<gasdefinitions><mix id="air"><name>air</name><o2>0.21</o2><he>0.0</he></mix><mix id="ean"><o2>0.32</o2></mix><mix id="tri"><o2>0.18</o2><he>0.45</he></mix><mix id="none"><he>0.1</he></mix></gasdefinitions>
<profiledata><repetitiongroup>
<dive id="d1"><informationbeforedive><link ref="who"/><link ref="s1"/><datetime>2026-03-06T19:07:42.000-04:00</datetime></informationbeforedive>
<tankdata><link ref="t3"/></tankdata><tankdata><link ref="t1"/></tankdata><tankdata><link ref="t3"/></tankdata><tankdata><link ref="t4"/></tankdata><tankdata><link ref="ean"/></tankdata>
<samples><waypoint><divetime>0</divetime><depth>0.0</depth></waypoint><waypoint><divetime>10</divetime></waypoint><waypoint><divetime>20</divetime><depth>5.5</depth><temperature>290.15</temperature><switchmix ref="air"/></waypoint>
<waypoint><divetime>30</divetime><depth>4</depth><switchmix ref="none"/></waypoint><waypoint><divetime>40</divetime><depth>2</depth><temperature>291.15</temperature></waypoint></samples>
<informationafterdive><greatestdepth>5.5</greatestdepth><diveduration>900000</diveduration><lowesttemperature>290.15</lowesttemperature><equipmentused><leadquantity>0.0</leadquantity></equipmentused></informationafterdive></dive>
</repetitiongroup><repetitiongroup>
<dive><informationbeforedive><link ref="site_69ab00ff12"/><datetime>yesterday</datetime></informationbeforedive><informationafterdive><equipmentused><leadquantity>4.0</leadquantity></equipmentused></informationafterdive></dive>
<dive id="d3"><samples><waypoint><divetime>1</divetime></waypoint></samples></dive></repetitiongroup></profiledata></uddf>
"""
OTHER = """<uddf><divesite><site id="s1"><name>Elsewhere</name></site></divesite><gasdefinitions><mix id="air"><o2>0.5</o2></mix></gasdefinitions><g><tankdata id="t1"><link ref="air"/></tankdata></g>
<profiledata><repetitiongroup><dive id="d1"><informationbeforedive><link ref="s1"/></informationbeforedive><tankdata><link ref="t1"/></tankdata></dive></repetitiongroup></profiledata></uddf>"""


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    texts = {"whole": WHOLE, "other": OTHER, "early": WHOLE[:2000], "root": "<log><uddf/></log>", "plain": "no xml at all", "none": "", "empty": "<uddf></uddf>", "short": " <uddf/>", "mark": "﻿" + OTHER, "after": WHOLE + "<more>"}
    for name, text in texts.items():
        (folder / f"{name}.uddf").write_text(text, encoding="utf-8")
    return documents.read_documents(spark, str(folder))


def name(file):
    return re.search(r"(\w+)\.uddf$", file)[1]


def test_what_files_are(read):
    codes = {name(r.file): r.code for r in read.files.collect()}
    # Spark passes over files without any byte
    bad = {"early", "plain", "after"}
    assert codes == {"whole": None, "other": None, "mark": None, "root": "not_uddf", "empty": "no_dives", "short": "no_dives"} | dict.fromkeys(bad, "unparseable_xml")
    for part in (read.sites, read.mixes, read.tanks, read.dives):
        assert {name(r.file) for r in part.collect()} == {"whole", "other", "mark"}


def test_parts_belong_to_their_file(read):
    by = lambda df: sorted((name(r.file), *r[1:]) for r in df.collect() if name(r.file) != "mark")
    # the last site of an id counts; opaque names and impossible altitudes are none
    assert by(read.sites) == [("other", "s1", "Elsewhere", None, None, None), ("whole", "s1", "Later", None, None, None), ("whole", "site_69ab00ff12", None, 3.0, 4.0, None)]
    assert by(read.mixes) == [("other", "air", 0.5, None, None), ("whole", "air", 0.21, None, "air"), ("whole", "ean", 0.32, None, None), ("whole", "tri", 0.18, 0.45, None)]
    assert by(read.tanks) == [("other", "t1", "air"), ("whole", "t1", "air"), ("whole", "t2", "ean"), ("whole", "t3", "tri"), ("whole", "t4", "gone")]


def test_dives_with_what_they_refer_to(read):
    got = {(name(r.file), r["at"]): r for r in documents.dive_observations(read).collect()}
    one, two, three, far = (got[k] for k in (("whole", 0), ("whole", 1), ("whole", 2), ("other", 0)))
    # tanks first, by way of their mixes and each mix once, then switches; ids that name nothing are dropped
    assert [g.o2 for g in one.gases] == [0.18, 0.21, 0.32] and [g.o2 for g in far.gases] == [0.5] and two.gases == three.gases == []
    assert (one.source_ref, one.site.name, far.site.name, three.site) == ("d1", "Later", "Elsewhere", None) and (two.source_ref, two.site.lat) == (None, 3.0)
    assert (one.start_local, one.offset_minutes, one.start_utc) == (datetime.datetime(2026, 3, 6, 19, 7, 42), -240, datetime.datetime(2026, 3, 6, 23, 7, 42))
    assert (one.max_depth_m, one.duration_s, one.weight_kg, round(one.water_temp_c, 6), two.weight_kg) == (5.5, None, None, 17.0, 4.0)
    assert [(i.code, i.field) for i in one.issues] == [("sentinel", "weight_kg"), ("out_of_range", "duration_s")] and [i.code for i in two.issues] == ["unreadable_datetime"] == [i.code for i in three.issues]
    assert one.series.time_s == [0, 20, 30, 40] and one.series.depth_m == [0, 5.5, 4, 2] and [round(t, 6) for t in one.series.temp_c] == [17, 17, 17, 18] and two.series is three.series is None


GAS, SITE = "array<struct<o2:double,he:double>>", "struct<name:string,lat:double,lon:double,altitude_m:double>"
DIVE = f"owner string, id int, start_local timestamp_ntz, offset_minutes int, site {SITE}, gases {GAS}, max_depth_m double, avg_depth_m double, duration_s long, water_temp_c double, weight_kg double, series struct<time_s:array<double>,depth_m:array<double>,temp_c:array<double>>"


def dive(owner, at, site=None, gases=None, series=None, start=None, offset=None, **other):
    return (owner, at, start, offset, site, gases, *(other.get(k) for k in ("depth", "mean", "long", "temp", "lead")), series)


@pytest.mark.parametrize("most", [2, 1000])
def test_written_documents_read_back(spark, tmp_path, most):
    start = datetime.datetime(2026, 1, 2, 3, 4, 5)
    rows = [
        dive("ann", 1, ("A <&> \"'", 1.5, 2.0, 10.0), [(0.32, None), (0.21, 0.0)], ([0.0, 10.0], [0.0, 12.25], [20.0, 19.5]), start, -210, depth=12.25, mean=6.0, long=1800, temp=19.5, lead=4.0),
        dive("ann", 2, (None, 5.0, 6.0, None), [(0.21, None)], ([0.0, 5.0], [0.0, 3.0], None), start, 60),
        dive("ann", 3, ("A <&> \"'", 9.0, 9.0, None), None, None, start, None, depth=1e-7),
        dive("ann", 4, (None, 5.0, None, None), [], ([], [], []), None, None),
        dive("ann", 5, ("B", None, None, None), [(0.18, 0.45)], ([0.0], [1.0], [None]), start, 0),
        dive("bob", 7, ("B", 1.0, 1.0, None), [(0.21, None)], None, start, 345, long=12345678901),
        dive(None, 8),
    ]
    lines = exports.documents(spark.createDataFrame(rows, DIVE).repartition(3), "owner", ["id"], "2026-01-01T00:00:00.000Z", most)
    exports.write_documents(lines, str(tmp_path / "out"))
    files = sorted(glob.glob(f"{tmp_path}/out/owner=*/part-*"))
    assert [re.search("owner=(\\w+)", f)[1] for f in files] == ["ann", "bob", "null"]
    text = open(files[0], encoding="utf-8").read()
    assert '<site id="site_1"><name>A &lt;&amp;&gt; &quot;&apos;</name><geography><latitude>1.5</latitude><longitude>2</longitude><altitude>10</altitude></geography></site>\n<site id="site_2"><name>site_2</name>' in text
    assert [m for m in re.findall(r'<mix id="(\w+)"><name>(\w+)</name><o2>([\d.]+)</o2>', text)] == [("mix_1", "ean32", "0.32"), ("mix_2", "air", "0.21"), ("mix_3", "ean18", "0.18")]
    assert "2026-01-02T03:04:05.000-03:30" in text and "<greatestdepth>0.0000001</greatestdepth>" in text and text.count("<he>") == 2
    assert "divesite" not in open(files[2]).read() and "<dive id=\"dive_1\"></dive>" in open(files[2]).read()
    back = documents.read_documents(spark, str(tmp_path / "out"))
    assert {r.code for r in back.files.collect()} == {None}
    got = {(re.search("owner=(\\w+)", r.file)[1], r.source_ref): r for r in documents.dive_observations(back).collect()}
    one, two, three, four, five = (got["ann", f"dive_{k}"] for k in range(1, 6))
    assert one.site == three.site and one.site.name == "A <&> \"'" and one.site.altitude_m == 10 and two.site.lat == 5 and four.site is None and five.site.name == "B" and got["bob", "dive_1"].site.lat == 1
    assert (one.start_local, one.offset_minutes, one.max_depth_m, one.avg_depth_m, one.duration_s, round(one.water_temp_c, 2), one.weight_kg) == (start, -210, 12.25, 6.0, 1800.0, 19.5, 4.0)
    assert [(g.o2, g.he) for g in one.gases] == [(0.32, None)] and one.series.depth_m == [0, 12.25] and [round(t, 2) for t in one.series.temp_c] == [20, 19.5] and two.series.temp_c is None and four.series is None
    assert [(g.o2, g.he) for g in five.gases] == [(0.18, 0.45)] and got["null", "dive_1"].start_local is None


def test_no_documents(spark):
    lines = exports.documents(spark.createDataFrame([], DIVE), "owner", ["id"], "now")
    assert lines.count() == 0


def test_numbers_as_text(spark):
    values = [0.0, 5.0, 100.0, 0.21, -3.5, 1e-7, 12345678.0, 1e15, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(exports.number_text(F.col("v"))).collect()
    assert [r[0] for r in got] == ["0", "5", "100", "0.21", "-3.5", "0.0000001", "12345678", "1000000000000000", None]


def test_json_logbooks(spark, tmp_path):
    texts = {
        "good": '{"format": "log/1", "more": 1, "dives": [{"ref": "r", "sources": [{"sourceRef": "s"}]}, {"sources": [{"sourceKind": "csv"}, {"sourceRef": "s2"}]}, {}, null, {"ref": null, "maxDepthM": 7.5}]}',
        "other": '{"format": "log/2", "dives": [{"ref": "x"}]}', "none": '{"dives": []}', "broken": '{"format": "log/1", "dives": [{', "empty": '{"format": "log/1"}', "list": "[1]",
    }
    for n, t in texts.items():
        (tmp_path / f"{n}.json").write_text(t)
    found, dives = files.read_json_logbooks(spark, str(tmp_path), "log/1")
    assert {re.search(r"(\w+)\.json$", r.file)[1]: r.code for r in found.collect()} == {"good": None, "other": "not_logbook", "none": "not_logbook", "broken": "unparseable_json", "empty": None, "list": "not_logbook"}
    assert sorted((r["at"], r.source_ref, r.dive.maxDepthM) for r in dives.collect()) == [(0, "r", None), (1, "s2", None), (2, None, None), (4, None, 7.5)]


def test_what_is_a_gas(spark):
    texts = {'[{"o2Fraction": 0.32, "heFraction": 0.1}, {"o2Fraction": 1}]': [(0.32, 0.1), (1.0, None)], '[{"o2Fraction": "0.3"}]': None, "[null, 1, [], {}]": None, "{}": None, "": None, "x": None, '[{"o2Fraction": 3e-1, "x": [1]}]': [(0.3, None)]}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", gases_of(F.col("t")).alias("g"))
    assert {r.i: r.g and [tuple(g) for g in r.g] for r in rows.collect()} == dict(enumerate([*texts.values(), None]))
