"""Places across the date line and the poles, names within names, orders and derived columns, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import audits, filters, lists, linking, merging, search, state, stats


def metres(a, b) -> float:
    (la, lo), (lb, lp) = [tuple(map(math.radians, x)) for x in (a, b)]
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [400.0, 60_000.0, 900_000.0])
def test_near_misses_no_place(spark, radius):
    rng = random.Random(3)
    spread = radius / 111_000
    centres = [(0.5, 179.9999), (89.9, 10.0), (-89.9999, -120.0), (60.0, 0.0), (-45.0, -179.9999), (10.0, 20.0)]
    near = lambda c: (max(-90.0, min(90.0, c[0] + rng.uniform(-spread, spread))), (c[1] + rng.uniform(-spread, spread) * rng.choice([1, 5]) + 540) % 360 - 180)
    points = [(i, *near(rng.choice(centres))) for i in range(120)] + [(500, None, 1.0), (501, 0.0, 0.0)]
    places = [(i, *near(rng.choice(centres))) for i in range(120)] + [(600, 0.0, 0.0), (601, 91.0, 0.0)]
    want = {(p[0], q[0]) for p in points[:120] for q in places[:120] if metres(p[1:], q[1:]) <= radius * (1 - 1e-9)}
    got = linking.near(spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame(places, "place_id int, lat double, lon double"), radius)
    assert want <= {(r.point_id, r.place_id) for r in got.collect()} and len(want) > 100


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def likeness(a: str, b: str) -> float:
    long, short = max(len(a), len(b)), min(len(a), len(b))
    return 1.0 if a == b else 0.8 + 0.15 * short / long if a in b or b in a else 1 - distance(a, b) / long


def test_names_alike_of_one_owner(spark):
    rng = random.Random(8)
    names = lambda n: [(rng.randint(1, 2), "".join(rng.choice("ab-") for _ in range(rng.randint(1, 12)))) for _ in range(n)]
    left, right = names(60) + [(1, None), (1, "")], names(60) + [(2, None)]
    want = {(o, a, b) for o, a in left for p, b in right if o == p and a and b and likeness(a, b) >= 0.85}
    schema = "owner int, name string"
    got = linking.named_alike(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["owner"], 0.85)
    assert {(r.owner, r.a, r.b) for r in got.collect()} == want and len(want) > 20


def test_rows_beside_the_longest_run(spark):
    rng = random.Random(2)
    rows = [(owner, k, k if owner else 0, rng.choice([None, 1, 2, 3, 4, 5, 6])) for owner in range(4) for k in range(9)]
    got = audits.out_of_order(spark.createDataFrame(rows, "owner int, key int, at int, number int"), "owner", "at", "number", "key").collect()
    for owner in range(4):
        mine = sorted([(a, n, k) for o, k, a, n in rows if o == owner and n is not None])
        beside = {r.key for r in got if r.owner == owner}
        stays = [n for _, n, k in mine if k not in beside]
        longest = max(bin(m).count("1") for m in range(1 << len(mine)) if (c := [mine[i][1] for i in range(len(mine)) if m >> i & 1]) == sorted(c))
        assert stays == sorted(stays) and len(stays) == longest
    assert audits.out_of_order(spark.createDataFrame([], "owner int, key int, at int, number int"), "owner", "at", "number", "key").count() == 0


def test_derived_columns(spark):
    rows = [("f", i, float(a), float(b), None if i == 2 else float(a + b), float(sum([3, 1, 4, 1, 5][: i + 1])), float(a - b)) for i, (a, b) in enumerate(zip([3, 1, 4, 1, 5], [2, 7, 1, 8, 2], strict=True))]
    rows += [("g", 0, 1.0, 2.0, 3.0, 1.0, -1.0), ("g", 1, 1.0, 2.0, 3.0, 2.0, -1.0), ("h", 0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "file string, i int, a double, b double, s double, c double, d double")
    got = {(r.file, r.column, r.kind, r.from_a, r.from_b) for r in audits.derived_columns(df, "file", "i", ["a", "b", "s", "c", "d"]).collect()}
    assert got >= {("f", "s", "sum", "a", "b"), ("f", "c", "cumulative", "a", None)} and {x[0] for x in got} == {"f"}
    # a = b + d is a sum, so no difference is told by a
    assert ("f", "a", "sum", "b", "d") in got and not [x for x in got if x[2] == "difference" and "a" in x[3:]]


def test_saved_views_and_parameters():
    assert filters.canonical({"tags": "b,a,b", "limit": "999", "cursor": "x", "from": "2024-01-02"}) == "from=2024-01-02&tags=a,b"
    assert filters.canonical({"from": "soon"}) == "" and filters.parse({}).size == 50
    for bad in ({"limit": "0"}, {"limit": "201"}, {"minDepth": "deep"}, {"hasProfile": "maybe"}):
        with pytest.raises(ValueError):
            filters.parse(bad)


def test_nulls_empties_and_ties(spark):
    rows = spark.createDataFrame([(1, None, None), (1, 2.0, "x"), (1, 2.0, "x"), (None, 1.0, "")], "owner int, amount double, tag string")
    assert {(r.owner, r.common, r.n) for r in stats.mode(rows, "owner", "tag").collect()} == {(1, "x", 2)}
    assert [r.amount for r in search.page(rows, "amount", "owner", 4).collect()] == [2.0, 2.0, 1.0, None]
    assert search.page_and_more(rows, "amount", "owner", 3).select("has_more").distinct().collect()[0][0] is True
    assert search.page_and_more(rows.limit(0), "amount", "owner", 3).count() == 0
    assert lists.extent(rows.limit(0).selectExpr("owner", "amount AS lat", "amount AS lon"), ["owner"]).count() == 0
    claims = spark.createDataFrame([(1, "rating", "a", 0, "2024-01-01", "s1"), (1, "rating", "b", 0, "2024-01-01", "s2"), (1, "rating", None, -1, "2024-01-02", "s3"), (2, "x", None, 0, None, "s")], "record int, field string, value string, rank int, recorded_at string, source string")
    assert [tuple(r) for r in merging.resolve(claims).collect()] == [(1, "rating", "a", "s1", 2, True)]
    lists_of = claims.select("record", "field", F.array("value").alias("value"), "rank", "recorded_at", "source")
    assert {r.contested for r in merging.resolve(lists_of.where("source != 's3' and record = 1")).collect()} == {True}
    sites = spark.createDataFrame([(1, "A", None, None, None), (2, "B", 1.0, 2.0, ["b", "A"])], "site_id int, name string, lat double, lon double, aliases array<string>")
    merged = state.merged_places(sites, spark.createDataFrame([(2, 1)], "from_id int, into_id int")).collect()
    assert [(r.site_id, r.name, r.lat, r.aliases) for r in merged] == [(1, "A", 1.0, ["B", "b"])]
    assert state.merged_places(sites, spark.createDataFrame([], "from_id int, into_id int")).count() == 2
