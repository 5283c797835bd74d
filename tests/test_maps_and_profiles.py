"""Names on maps, the profile store, damaged blobs, and slugs of all characters of the basic plane."""

import glob
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from logweave.functions import series
from logweave.functions.text import slug
from logweave.operators import maps
from logweave.operators.places import plain
from logweave.sources import profiles


def test_labels_against_a_plain_loop(spark):
    rng = random.Random(8)
    names = ["Reef", "Blue Hole of the north", "😀😀😀", "", None, "á", "z"]
    rows = [("hot" if k % 3 else rng.choice(["x", None]), k, rng.choice(names), rng.choice([None, 0, 1, 2, 3]), rng.uniform(0, 300), rng.uniform(0, 120)) for k in range(600)]
    df = spark.createDataFrame(rows, "m string, k int, n string, w int, x double, y double").repartition(4)
    got = {r.k: r.show_label for r in maps.labelled(df, "m", "k", "n", "w").collect()}
    rank = {n: i for i, n in enumerate([None, "", "😀😀😀", "á", "Blue Hole of the north", "Reef", "z"])}
    boxes, want = {}, {}
    for m, k, n, w, x, y in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), rank[r[2]], r[1])):
        half = len((n or "").encode("utf-16-le")) / 2 * 6.2 / 2
        own = boxes.setdefault(m, [])
        box = (x - half, x + half, y - 29, y - 14)
        want[k] = not any(box[0] < o[1] and box[1] > o[0] and box[2] < o[3] and box[3] > o[2] for o in own)
        if want[k]:
            own.append(box)
    assert got == want and 20 < sum(want.values()) < 580


def test_frames_of_few_and_odd_places(spark):
    rows = [("one", 10.0, 20.0), ("odd", 91.0, 0.0), ("odd", float("nan"), 0.0), ("odd", None, 1.0), ("odd", 0.0, 0.0), ("far", 60.0, -170.0), ("far", 70.0, 170.0)]
    df = spark.createDataFrame([(m, a, b, i) for i, (m, a, b) in enumerate(rows)], "m string, lat double, lon double, k int")
    got = {r.m: r for r in maps.frames(df, ["m"]).collect()}
    assert (got["one"].n, got["odd"].n, got["far"].n) == (1, 1, 2) and round(got["one"].north - got["one"].south, 6) == 0.05625 and got["one"].span_km == 6.2
    drawn = {r.k: (r.x, r.y) for r in maps.drawn(df, ["m"]).collect()}
    assert drawn[0] == drawn[4] == (450.0, 230.0) and drawn[5][0] < drawn[6][0] and drawn[5][1] > drawn[6][1] and len(drawn) == 4
    assert maps.frames(df.limit(0), ["m"]).count() == 0


def test_a_repeated_run_stores_nothing_new(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, 1, b"a"), (1, 2, b"a"), (2, 3, b"a"), (1, 4, None), (1, 5, b""), (1, 6, b"\x00\xff\n")], "owner long, record long, blob binary")
    assert profiles.stored(spark, path).count() == 0
    first = profiles.store(rows, path).collect()
    files = sorted(glob.glob(f"{path}/**/*.parquet", recursive=True))
    assert profiles.stored(spark, path).count() == 4 and len({r.storage_key for r in first}) == 5
    second = profiles.store(rows.unionByName(rows), path)
    assert sorted(glob.glob(f"{path}/**/*.parquet", recursive=True)) == files and second.count() == 12
    back = {r.record: r.blob for r in profiles.fetched(spark, path, second).collect()}
    assert back == {1: b"a", 2: b"a", 3: b"a", 4: None, 5: b"", 6: b"\x00\xff\n"}
    profiles.store(spark.createDataFrame([(9, 9, b"new")], rows.schema), path)
    assert profiles.stored(spark, path).count() == 5


@pytest.mark.parametrize(
    ("blob", "said"),
    [(None, None), (b"", "truncated"), (b"MD", "truncated"), (b"XD", "bad magic"), (b"MDL1", "truncated"), (b"MDL1\x02", "unsupported version 2"), (b"MDL1\x01", "truncated"), (b"MDL1\x01\x01", "truncated"), (b"MDL1\x01\x00\x05", None), (b"MDL1\x01\x01\x02\x02", "truncated"),
     (b"MDL1\x01\x01\x02\x02\x02", None), (b"MDL1\x01\x01\x02\x02\x82", "truncated"), (b"MDL1\x01\x01\x02\x02\x02\xff", None), (b"MDL1\x01\x01\x01" + b"\xff" * 6 + b"\x01", "varint too long"), (b"MDL1\x01\x01" + b"\xff" * 9, "varint too long"), (b"MDL1\x01\x03\x01\x02", "truncated")],
)
def test_damage(blob, said):
    assert series.damage_of(blob) == said
    if blob and said is None and blob[5] & 1:
        assert series.samples_of(blob, "timeS") == [1.0, 2.0]


def test_slugs_of_the_whole_basic_plane(spark):
    letters = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800))]
    rows = spark.createDataFrame([(c, f"a{c}B") for c in letters] + [("long", "ﬁ½ " * 20_000)], "c string, s string").repartition(8)
    got = {r.c: r.g for r in rows.select("c", slug(F.col("s")).alias("g")).collect()}
    want = lambda s: re.sub("[^a-z0-9]+", "-", "".join(x for x in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(x) <= 0x36F).lower()).strip("-")
    assert [c for c in letters if got[c] != want(f"a{c}B") or plain(f"a{c}B") != got[c]] == [] and got["long"] == want("ﬁ½ " * 20_000)
