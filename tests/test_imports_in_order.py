"""Imports in which later rows and batches see what earlier ones made."""

import random
from datetime import datetime, timedelta

import pytest

from logweave.operators import batches, places

OBS, SITE = "owner string, row long, name string, lat double, lon double", "owner string, site_id string, name string, lat double, lon double, aliases array<string>"
REEF = (10.0, 20.0)


def placed(spark, rows, sites=()):
    observed = spark.createDataFrame(rows, OBS).repartition(5)
    found, after = places.resolved_places(observed, spark.createDataFrame(list(sites), SITE))
    return {(r.owner, r.row): (r.site_id, r.rule) for r in found.collect()}, {(r.owner, r.site_id): (r["name"], r.lat, r.lon, r.aliases) for r in after.collect()}


def test_a_placeholder_takes_the_first_real_name(spark):
    rows = [
        ("a", 1, None, *REEF),  # a watch: no name
        ("a", 2, "1,000 Steps", *REEF),  # names it
        ("a", 3, "Thousand Steps", 10.0001, 20.0),  # 11 m away: another spelling
        ("a", 4, "1000 steps", None, None),  # by its name
        ("a", 5, "THOUSAND steps!", None, None),  # by its alias
        ("a", 6, "1,000 Steps", *REEF), ("a", 7, None, None, None), ("a", 8, None, 0.0, 0.0), ("a", 9, "Thousand Steps", *REEF),
        ("b", 1, "1,000 Steps", None, None),  # another owner knows nothing of it
        ("b", 2, "1000 steps", 11.0, 20.0),  # by name, and gives it its place
        ("b", 3, "Elsewhere", 11.0, 20.0), ("b", 4, None, 11.0, 20.0), ("b", 5, "1,000 step", 11.002, 20.0),
        (None, 1, "X", None, None),
    ]
    found, after = placed(spark, rows)
    assert [found["a", k] for k in range(1, 10)] == [("a/1", "made"), ("a/1", "coordinates"), ("a/1", "coordinates"), ("a/1", "name"), ("a/1", "alias"), ("a/1", "coordinates"), (None, None), ("a/8", "made"), ("a/1", "coordinates")]
    assert [found["b", k] for k in range(1, 6)] == [("b/1", "made"), ("b/1", "name"), ("b/1", "coordinates"), ("b/1", "coordinates"), ("b/1", "coordinates-and-name")]
    assert after["a", "a/1"] == ("1,000 Steps", *REEF, ["Thousand Steps", "1000 steps", "THOUSAND steps!"]) and after["a", "a/8"] == (places.UNNAMED, 0.0, 0.0, [])
    assert after["b", "b/1"] == ("1,000 Steps", 11.0, 20.0, ["1000 steps", "Elsewhere", "1,000 step"]) and found[None, 1][1] == "made" and len(after) == 4


def test_known_sites_come_first(spark):
    sites = [("a", "s2", "Blue Hole", None, None, ["The Hole"]), ("a", "s1", places.UNNAMED, *REEF, None), ("a", "s3", None, 30.0, 30.0, []), ("z", "s9", "Blue Hole", *REEF, [])]
    found, after = placed(spark, [("a", 1, "the hole", None, None), ("a", 2, "Blue Hole", *REEF), ("a", 3, "Blue Hole", None, None), ("a", 4, "Three", 30.0, 30.0)], sites)
    # the place goes before the name; of equal names the older site
    assert [found["a", k] for k in range(1, 5)] == [("s2", "alias"), ("s1", "coordinates"), ("s1", "name"), ("s3", "coordinates")]
    assert after == {("a", "s1"): ("Blue Hole", *REEF, []), ("a", "s2"): ("Blue Hole", None, None, ["The Hole", "the hole"]), ("a", "s3"): ("Three", 30.0, 30.0, []), ("z", "s9"): ("Blue Hole", *REEF, [])}


def naive(rows, sites):
    """All rules for each row anew, over a plain list of sites."""
    found, all_sites = {}, {}
    for owner, key, name, lat, lon, aliases in sorted(sites, key=lambda s: s[1]):
        all_sites.setdefault(owner, []).append([key, name, lat, lon, list(aliases)])
    for owner, row, name, lat, lon in sorted(rows, key=lambda r: r[1]):
        own, hit, rule = all_sites.setdefault(owner, []), None, None
        if name is None and lat is None:
            found[owner, row] = (None, None)
            continue
        located = sorted(((places.metres(lat, lon, s[2], s[3]), i) for i, s in enumerate(own) if s[2] is not None), key=lambda x: x[0]) if lat is not None else []
        if located and located[0][0] <= 50:
            hit, rule = own[located[0][1]], "coordinates"
        if hit is None and name is not None:
            for m, i in located:
                if m <= 250 and places.alike(places.plain(name), places.plain(own[i][1])) > 0.6:
                    hit, rule = own[i], "coordinates-and-name"
                    break
        if hit is None and name is not None:
            scores = [places.alike(places.plain(name), places.plain(s[1])) for s in own]
            if scores and max(scores) >= 0.85:
                hit, rule = own[scores.index(max(scores))], "name"
        if hit is None and name is not None:
            hit, rule = next((s for s in own if places.plain(name) in map(places.plain, s[4])), None), "alias"
        if hit is None:
            own.append([f"{owner}/{row}", name or places.UNNAMED, lat, lon, []])
            found[owner, row] = (f"{owner}/{row}", "made")
            continue
        if hit[2] is None and lat is not None:
            hit[2:4] = lat, lon
        if hit[1] == places.UNNAMED and name is not None:
            hit[1] = name
        if name is not None and places.plain(name) != places.plain(hit[1]) and name not in hit[4]:
            hit[4].append(name)
        found[owner, row] = (hit[0], rule)
    return found, {(o, s[0]): (s[1], s[2], s[3], s[4]) for o, ss in all_sites.items() for s in ss}


def test_against_a_plain_loop(spark):
    rng = random.Random(4)
    words = ["Blue", "blue", "Hole", "Reef", "Old", "Wall", "Bay", "hole"]
    rows = []
    for row in range(700):
        name = None if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        lat = None if rng.random() < 0.4 else 10 + rng.randint(0, 12) * 0.0006
        rows.append((rng.choice("aab"), row, name, lat, None if lat is None else 20.0))
    sites = [("a", "k1", "Blue Hole", None, None, ["Azure"]), ("a", "k2", "Bay", 10.003, 20.0, [])]
    got, want = placed(spark, rows, sites), naive(rows, sites)
    assert got == want and {r for _, r in got[0].values()} == {None, "made", "coordinates", "coordinates-and-name", "name", "alias"}


def test_no_rows(spark):
    assert placed(spark, []) == ({}, {})
    assert placed(spark, [], [("a", "s", "S", None, None, None)]) == ({}, {("a", "s"): ("S", None, None, [])})


def test_later_batches_see_what_earlier_ones_made(spark):
    at = datetime(2024, 5, 1, 10)
    minute, day = timedelta(minutes=1), timedelta(days=1)
    watch = "owner string, row long, source_ref string, start_local timestamp, start_utc timestamp, max_depth_m double, duration_s double, gas double, lat double, lon double"
    sheet = "owner string, row long, source_ref string, start_local timestamp, max_depth_m double, duration_s double, gas double, site_name string, suspect boolean"
    first = [("a", 1, "w1", at, at + 60 * minute, 20.0, 3000.0, 0.32, *REEF), ("a", 2, "w2", at + day, None, 30.0, 2400.0, 0.21, *REEF), ("a", 3, "w3", at + 3 * day, None, None, None, None, None, None)]
    second = [
        ("a", 1, None, at + 2 * minute, 20.4, 3060.0, 0.33, "Reef", False),  # the watch's first dive
        ("a", 2, None, at + day, 30.0, 2400.0, 0.21, "Reef", True),  # its second, but no zone to trust
        ("a", 3, None, at + 9 * day, 12.0, 1800.0, None, "Bay", False),  # a new dive
        ("a", 4, None, at + 3 * minute, 20.0, 3000.0, 0.32, "Reef", False),  # also the first: less close in nothing, but later in the file
        ("b", 5, None, at, 20.0, 3000.0, 0.32, "Reef", False),  # another diver
    ]
    third = [("a", 1, "w1", at, at + 60 * minute, 20.0, 3000.0, 0.32, *REEF), ("a", 2, None, at + 9 * day, None, 12.2, 1790.0, 0.21, None, None)]
    done = batches.run([("uddf", spark.createDataFrame(first, watch)), ("spreadsheet", spark.createDataFrame(second, sheet)), ("uddf", spark.createDataFrame(third, watch))])
    told = {(r.batch, r.row): (r.decision, r.record) for r in done.decisions.collect()}
    later = batches.ROWS
    assert told == {
        (0, 1): ("create", 1), (0, 2): ("create", 2), (0, 3): ("create", 3),
        (1, 1): ("merge", 1), (1, 2): ("ambiguous", later + 2), (1, 3): ("create", later + 3), (1, 4): ("ambiguous", later + 4), (1, 5): ("create", later + 5),
        (2, 1): ("merge", 1), (2, 2): ("merge", later + 3),  # what the second batch made
    }
    records = {(r.owner, r.record): r for r in done.records.collect()}
    one = records["a", 1]
    # the sheet names the site; what the watch measured and sensed stays
    assert (one.n_sources, one.source_refs, one.max_depth_m, one.gas, one.site_name, one.start_local, one.lat) == (3, ["w1"], 20.0, 0.32, "Reef", at, 10.0)
    two = records["a", later + 3]
    assert (two.n_sources, two.max_depth_m, two.site_name, two.gas) == (2, 12.2, "Bay", 0.21)
    assert len(records) == 7 and records["b", later + 5].site_name == "Reef" and done.sources.count() == 10
    with pytest.raises(ValueError, match="batch"):
        batches.run([])
