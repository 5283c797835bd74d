"""Column functions on edge cases that the tables do not hold."""

from pyspark.sql import functions as F

from logweave.functions import offsets, series, units
from logweave.functions.text import name_similarity, slug
from logweave.operators import taxonomy


def test_series_round_trip_and_damage(spark):
    rows = [(1, [0.0, 15.0, 30.0], [0.0, 12.345, -3.2]), (2, [], []), (3, None, [1.0]), (4, [1.0], [1.0, 2.0]), (5, [1.0, None], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, t array<double>, d array<double>").withColumn("blob", series.encode({"depthM": F.col("d"), "timeS": F.col("t")}))
    damaged = F.substring("blob", 1, 9)
    got = df.select("id", "blob", series.decode(F.col("blob"), "timeS").alias("t"), series.decode(F.col("blob"), "depthM").alias("d"), series.decode(F.col("blob"), "tempC").alias("none"), series.decode(damaged, "depthM").alias("cut")).orderBy("id").collect()
    assert bytes(got[0].blob[:7]) == b"MDL1\x01\x03\x03" and got[0].t == [0, 15, 30] and got[0].d == [0, 12.345, -3.2] and got[0].none is None and got[0].cut is None
    assert got[1].t == [] and [r.blob for r in got[2:]] == [None] * 3


def test_damaged_series_are_null():
    blob = bytes.fromhex("4D444C31" + "01" + "02" + "02" + "8008" + "01")
    assert series.samples_of(blob, "depthM") == [0.512, 0.511]
    for bad in (None, b"", blob[:-1], blob[:6], b"X" + blob[1:], blob[:4] + b"\x02" + blob[5:], blob[:-1] + b"\x80", blob[:7] + b"\x80" * 5 + b"\x01\x01"):
        assert series.samples_of(bad, "depthM") is None
    # bytes after the last sample are read by nobody
    assert series.samples_of(blob + b"\x01", "depthM") == [0.512, 0.511]
    assert series.samples_of(blob, "timeS") is None


def test_edit_budget_finds_all_within_it(spark):
    words = ["abcdefg", "abcdef", "abcd", "abc", "ab", "bacdefg", "abcdxyg", "gfedcba"]
    tags = ["abcdefg", "abcdef", "bcdefg", "abdcefg", "abcdxfg", "xbcdefgy", "abce", "ab", "a", "abcdefgxyz", "acd"]
    got = {r.input: (r.kind, r.slug, r.distance) for r in taxonomy.match(spark.createDataFrame([(t,) for t in tags], "tag string"), "tag", [(w, w, []) for w in words]).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for t in tags:
        near = min(((distance(t, w), k) for k, w in enumerate(words)), default=None)
        budget = 0 if len(t) <= 3 else 1 if len(t) <= 6 else 2
        want = ("exact", t, None) if t in words else ("fuzzy", words[near[1]], near[0]) if near[0] <= budget else ("new", t, None)
        assert got[t] == want, t


def test_offsets(spark):
    df = spark.createDataFrame([(-4, -240), (-4, -300), (-4, None), (-240, None), (None, 60)], "m int, place int")
    got = [tuple(r.r) for r in df.select(offsets.repaired(F.col("m"), F.col("place")).alias("r")).collect()]
    assert got == [(-240, False, "high"), (-4, True, "low"), (-4, True, "low"), (-240, False, None), (None, False, None)]
    times = spark.createDataFrame([(None, 3600, 60), (0, None, -60), (0, 7200, None), (None, None, 5)], "u long, l long, m int")
    assert [tuple(r.r) for r in times.select(offsets.completed(F.col("u"), F.col("l"), F.col("m")).alias("r")).collect()] == [(0, 3600, 60), (0, -3600, -60), (0, 7200, 120), (None, None, 5)]


def test_names_and_units(spark):
    df = spark.createDataFrame([("Café  Réef!", "cafe reef"), ("Coral Arch", "Coral Arch East"), ("", "x"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1 and abs(got[1] - (0.8 + 0.15 * 10 / 15)) < 1e-12 and got[2] == 0 and got[3] is None
    assert [r[0] for r in df.select(slug(F.col("a"))).collect()] == ["cafe-reef", "coral-arch", "", None]
    one = spark.range(1).select(units.serial_to_date(F.lit(40000.5)).cast("string"), units.serial_to_date(F.lit(0.5)).cast("string"), units.fraction_to_seconds(F.lit(0.5)), units.fraction_to_seconds(F.lit(1.0)), units.next_milestone(F.lit(100)), units.next_milestone(F.lit(-1)))
    assert tuple(one.first()) == ("2009-07-06", None, 43200, None, 150, None)


def test_taxonomy_nulls_and_ties(spark):
    tags = spark.createDataFrame([("Crve",), ("crve",), (None,), ("",), ("NIGHT",), ("by boat",)], "tag string")
    got = {r.input: (r.kind, r.slug) for r in taxonomy.match(tags, "tag", [("curve", "Curve", []), ("night", "Night", []), ("boat", "Boat", ["By  boat"])]).collect()}
    assert got == {"Crve": ("fuzzy", "curve"), "crve": ("fuzzy", "curve"), "": ("new", ""), "NIGHT": ("exact", "night"), "by boat": ("alias", "boat")}
