"""Imports taken back to the last column, what disagrees on the screen, staff changes with their events, sheets read back."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweave.functions import display
from logweave.operators import filters, lists, merging, relations, reverts, sheets, state
from logweave.sources import exports, files

AT = datetime(2024, 5, 1, 10)


def test_a_revert_clears_what_nothing_asserts(spark):
    kind = "owner string, record long, batch int, row long, kind string, source_ref string, recorded_at timestamp, start_local timestamp, start_utc timestamp, offset_minutes int, max_depth_m double, notes string"
    hour = timedelta(hours=1)
    sources = [
        ("a", 1, 0, 1, "uddf", "w1", AT, AT, AT + 4 * hour, -240, 20.0, None), ("a", 1, 1, 1, "spreadsheet", None, AT, AT, None, None, 21.0, "seen"),  # both sides of one dive
        ("a", 2, 1, 2, "spreadsheet", None, AT, AT, None, None, 5.0, None),  # only the sheet
        ("a", 3, 0, 2, "uddf", "w2", AT, None, None, None, 9.0, None), ("a", 3, 1, 3, "manual", None, AT, AT, None, 60, None, "x"),
        ("a", 4, 0, 3, "uddf", "w3", AT, AT, None, 60, 1.0, None),  # untouched
        ("a", 5, 0, 4, "uddf", None, AT, None, AT, 120, None, None), ("a", 5, 1, 5, "csv", None, AT, None, None, None, 3.0, None),
    ]
    df = spark.createDataFrame(sources, kind).repartition(3)
    old = spark.createDataFrame([("a", k, AT - hour, AT - 2 * hour) for k in range(1, 6)], "owner string, record long, start_utc timestamp, start_local timestamp")
    fields = {"start_local": "startTimeLocal", "start_utc": "startTimeUtc", "offset_minutes": "tzOffsetMinutes", "max_depth_m": "maxDepthM", "notes": "notes"}
    gone = lambda *b: spark.createDataFrame([(x,) for x in b], "batch int")
    got = lambda *b: {r.record: tuple(r)[2:] for r in reverts.reverted(old, df, gone(*b), fields).collect()}
    assert got(1) == {
        1: ("kept", AT, AT + 4 * hour, -240, 20.0, None),
        2: ("deleted", None, None, None, None, None),
        3: ("kept", AT - 2 * hour, AT - hour, 0, 9.0, None),  # no source tells a time: as it was
        5: ("kept", AT + 2 * hour, AT, 120, None, None),
    }
    first = got(0)
    # without an offset the clock's time is taken for universal time; the offset falls back
    assert first[1] == ("kept", AT, AT, 0, 21.0, "seen") and first[3] == ("kept", AT, AT - hour, 60, None, "x") and first[5] == ("kept", AT - 2 * hour, AT - hour, 0, 3.0, None) and set(first) == {1, 3, 4, 5}
    assert {v[0] for v in got(0, 1).values()} == {"deleted"} and got(7) == {} and reverts.reverted(old, df.limit(0), gone(1), fields).count() == 0


def test_units_of_choice(spark):
    rows = spark.createDataFrame([(14.099,), (14.0208,), (0.0,), (None,), (-1.5,)], "v double")
    say = lambda f, *prefs: [r[0] for r in rows.select(f(F.col("v"), *prefs)).collect()]
    feet = display.Units("imperial", weight="kg")
    assert say(display.depth) == ["14.1 m", "14.0 m", "0.0 m", "—", "-1.5 m"] and say(display.depth, feet) == ["46 ft", "46 ft", "0 ft", "—", "-5 ft"]
    assert say(display.temperature, feet)[:2] == ["57 °F", "57 °F"] and say(display.weight, feet)[0] == "14.1 kg" and say(display.weight, display.Units("metric", weight="lb"))[0] == "31 lb"
    assert say(display.pressure, display.Units(pressure="psi"))[0] == "204 psi" and say(display.pressure)[0] == "14 bar" and say(display.duration)[:3] == ["0 min", "0 min", "0 min"]
    fields = [("maxDepthM", "14.099"), ("durationS", "2776"), ("startTimeLocal", "2024-05-01T19:07:42.000Z"), ("rating", "4.50000"), ("notes", "hello"), ("rating", "0.123456"), ("notes", None), ("maxDepthM", "deep")]
    shown = spark.createDataFrame(fields, "p string, v string").select(display.field_value(F.col("p"), F.col("v")))
    assert [r[0] for r in shown.collect()] == ["14.1 m", "46 min", "2024-05-01 19:07", "4.5", "hello", "0.1235", "—", "deep"]


def test_what_looks_alike_does_not_disagree(spark):
    rows = [(1, "maxDepthM", "14.099", 0, "s1"), (1, "maxDepthM", "14.0208", 1, "s2"), (1, "notes", "a", 0, "s1"), (1, "notes", "b", 2, "s2"), (2, "maxDepthM", "1", 0, "s1"), (2, "maxDepthM", None, 0, "s2"), (1, "tags", "x", 5, "s9")]
    df = spark.createDataFrame(rows, "record int, field string, value string, rank int, source string").withColumn("recorded_at", F.lit(AT))
    shown = lambda prefs: {(r.record, r.field): r.shown for r in merging.shown_conflicts(df, display.field_value(F.col("field"), F.col("value"), prefs)).collect()}
    assert shown(display.Units("imperial")) == {(1, "notes"): ["a", "b"]} and shown(display.METRIC) == {(1, "notes"): ["a", "b"], (1, "maxDepthM"): ["14.0 m", "14.1 m"]}
    # every source adds to notes and tags; one wins a depth
    assert {(r.record, r.field, r.source) for r in merging.provenance(df).where("is_selected").collect()} == {(1, "maxDepthM", "s1"), (1, "notes", "s1"), (1, "notes", "s2"), (2, "maxDepthM", "s1"), (1, "tags", "s9")}


def test_no_change_without_its_event(spark):
    rows = spark.createDataFrame([(1, 1, None, "a"), (2, 1, None, "b")], "id int, version int, deleted_at timestamp, name string")
    kind = "id int, seq int, action string, at timestamp, actor string, reason string, name string"
    changes = [(1, 1, "patch", AT, "x", "typo", "A"), (1, 1, "patch", AT, "y", "typo", "Z"), (2, 1, "delete", AT, "x", "asked", None), (3, 1, "patch", AT, "x", "gone", "C"), (4, 1, "create", AT, "y", "new", "D"), (2, 2, "restore", AT, None, "oops", None)]
    after, events = state.staff_changes(rows, spark.createDataFrame(changes, kind), "id", ["name"], "site")
    assert {(r.id, r.version, r.deleted_at, r["name"]) for r in after.collect()} == {(1, 2, None, "A"), (2, 3, None, "b"), (4, 1, None, "D")}
    assert {(r.actor_id, r.action, r.entity_id, r.reason, r.fields) for r in events.collect()} == {("x", "site.patch", "1", "typo", "name"), ("x", "site.delete", "2", "asked", ""), ("y", "site.create", "4", "new", "name"), (None, "site.restore", "2", "oops", "")}
    users = spark.createDataFrame([("x", "x@a.b"), ("z", "z@a.b")], "user_id string, email string")
    log = lambda **asked: {(r.action, r.actor_email) for r in state.audit_log(events, users, **asked).collect()}
    assert log() == {("site.patch", "x@a.b"), ("site.delete", "x@a.b"), ("site.create", None), ("site.restore", None)} and log(entity_id="2", actor_id="x") == {("site.delete", "x@a.b")} and log(entity_type="tag") == set() and len(log(most=2)) == 2


def test_a_logbook_sheet_reads_back(spark, tmp_path):
    none = None
    kind = "dive_number int, start_local timestamp, duration_s int, max_depth_m double, air_temp_c double, water_temp_c double, visibility_m double, site struct<region:string,name:string,lat:double,lon:double>, water_type string, tags array<string>, gases array<struct<o2:double,he:double>>, gear string, weight_kg double, buddies array<string>, rating int, notes string"
    rows = [(1, AT, 1830, 18.5, 25.0, 19.25, 10.0, ("Bonaire", "1,000 Steps", 12.1, -68.2), "salt", ["Shore", "Night, late"], [(0.32, none)], "BCD; fins", 4.0, ["Ann", 'B "Bee"'], 4, 'a "b"\nc'), (2, none, none, none, none, none, none, none, none, none, none, none, none, none, none, none)]
    for imperial in (False, True):
        path = str(tmp_path / f"out{imperial}")
        exports.write_sheet(exports.logbook_sheet(spark.createDataFrame(rows, kind).coalesce(1), "dive_number", imperial), path)
        table = files.read_delimited(spark, path, ",")
        assert len(table.columns) == 21
        mapping, left = sheets.guess(table.columns[:-1])
        assert left == ["Latitude", "Longitude"]
        one = sheets.observations(table.where("`Dive Number` = '1'"), mapping, []).first()
        assert (one.dive_number, one.start_local, one.site_name, one.water_type, one.o2, one.notes, one.rating, one.duration_s) == (1, AT, "1,000 Steps", "salt", 0.32, 'a "b"\nc', 4.0, 1860)
        assert one.max_depth_m == pytest.approx(18.5, abs=1e-3) and one.water_temp_c == pytest.approx(19.25, abs=1e-3) and one.weight_kg == pytest.approx(4, abs=1e-3) and [i.code for i in one.issues] == []


def test_views_and_sizes(spark):
    texts = ["?tags=b,a,b&limit=7", "sort=sideways", None, "", "q=a%26b&q=c", "hasProfile=perhaps", "limit=abc&from=2024-01-02"]
    got = filters.canonical_views(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string"), "v").collect()
    assert {r.i: r.canonical for r in got} == {0: "tags=a,b", 1: "", 2: None, 3: "", 4: "q=c", 5: "", 6: "from=2024-01-02"}
    rows = spark.createDataFrame([(1, "merge", ["a", "b"]), (1, "create", None), (2, "merge", [])], "batch int, decision string, issues array<string>")
    assert {tuple(r) for r in lists.import_stats(rows, "batch", "decision", ["merge"], ["issues"]).collect()} == {(1, 2, 1, 2), (2, 1, 1, 0)}


def test_ranks_by_the_fixed_preferences(spark):
    fields = [f for fs in merging.CLASSES.values() for f in fs] + ["other"]
    kinds = [*merging.ORIGINS, "unheard", None]
    class_of = lambda f: next((c for c, fs in merging.CLASSES.items() if f in fs), "measured")
    for sensed in (None, True):
        rows = spark.createDataFrame([(f, k) for f in fields for k in kinds], "f string, k string")
        told = None if sensed is None else F.lit(sensed)
        for r in rows.select("f", "k", merging.rank(F.col("f"), F.col("k"), told).alias("rank")).collect():
            origin = merging.ORIGINS.get(r.k, "file_import")
            first = class_of(r.f) == "configured" and origin == "instrument" and (sensed or r.f in merging.SENSED.get(r.k, []))
            assert r["rank"] == (-1 if first else merging.PREFERENCES[class_of(r.f)].index(origin)), (r, sensed)


def test_whole_dives_lack_what_they_lack(spark):
    dives = spark.createDataFrame([(1, "me", 5, AT, None), (2, "me", 6, AT - timedelta(days=1), None), (3, "me", None, AT, AT), (4, "you", 5, AT, None)], "dive int, owner string, site_id int, start_utc timestamp, deleted_at timestamp")
    good = bytes.fromhex("4D444C31" + "01" + "02" + "02" + "8008" + "01")
    parts = {
        "sites": spark.createDataFrame([(5, "B", 1.0, 2.0), (5, "A", None, None)], "site_id int, name string, lat double, lon double"),
        "tags": spark.createDataFrame([(1, "z"), (1, "a"), (1, None), (9, "x")], "dive int, label string"),
        "buddies": spark.createDataFrame([], "dive int, name string"),
        "sources": spark.createDataFrame([(1, "s2", "csv", AT), (1, "s1", "uddf", AT + timedelta(days=1)), (1, "s0", "csv", None)], "dive int, source string, kind string, recorded_at timestamp"),
        "assertions": spark.createDataFrame([(1, "notes", "s2", "n", True), (1, "depth", "s2", "2", False), (1, "depth", "s1", "1", True)], "dive int, field string, source string, value string, is_selected boolean"),
        "profiles": spark.createDataFrame([(1, good), (2, b"bad")], "dive int, blob binary"),
    }
    got = relations.export_plan(dives, "owner", "me", **parts).collect()
    assert [r.dive for r in got] == [2, 1]
    two, one = got
    assert (two.site, two.tags, two.buddies, two.sources, two.provenance, two.samples) == (None, [], [], [], [], None) and bytes(two.profile) == b"bad"
    assert (one.site["name"], one.tags, [s.source for s in one.sources], [(p.field, p.source, p.value) for p in one.provenance], one.samples) == ("A", ["a", "z"], ["s0", "s2", "s1"], [("depth", "s1", "1"), ("depth", "s2", "2"), ("notes", "s2", "n")], [0.512, 0.511])
    assert relations.whole_dives(dives.limit(0), **parts).count() == 0
