"""Values along an owner's rows against a plain loop, where owners are cut into ranges and where they are not."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from logweave.operators import audits, cleaning, merging, relations, running, state, stats

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """One owner with a third of all rows; rows without a time, a number or a length; equal times; a null owner."""
    rng = random.Random(11)
    out = []
    for key in range(1800):
        owner = 7 if key % 3 == 0 else None if key % 50 == 1 else rng.randint(100, 160)
        when = None if rng.random() < 0.03 else START + datetime.timedelta(minutes=rng.randint(0, 90_000))
        out.append((owner, when, key, None if rng.random() < 0.2 else rng.randint(1, 400), None if rng.random() < 0.1 else rng.uniform(0, 90_000), rng.choice([None, -600, 0, 720])))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "owner long, when timestamp, key long, number long, seconds double, offset int").repartition(5).cache()


def owners(rows):
    order = lambda r: (r[1] is not None, r[1] or START, r[2])
    groups: dict = {}
    for r in sorted(rows, key=order):
        groups.setdefault(r[0], []).append(r)
    return groups


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


CUTS = pytest.mark.parametrize("most", [40, 10_000])


@CUTS
def test_numbering(df, rows, most):
    want = [(r[2], n) for g in owners(rows).values() for n, r in enumerate(g, 5)]
    assert got(stats.numbering(df, "owner", "when", "key", 5, most), "key", "number") == sorted(want, key=repr)
    with pytest.raises(ValueError, match="start"):
        stats.numbering(df, "owner", "when", "key", -1)


@CUTS
def test_intervals(df, rows, most):
    want = []
    for g in owners(rows).values():
        end, day, repetition = None, object(), 0
        for _, when, key, _, seconds, offset in g:
            own = when and (when + datetime.timedelta(minutes=offset or 0)).date()
            repetition = repetition + 1 if own == day else 1
            day = own
            gap = None if when is None or end is None else round((when - START).total_seconds() - end)
            want.append((key, gap if gap is not None and gap >= 0 else None, repetition))
            end = None if when is None or seconds is None else (when - START).total_seconds() + seconds
    found = stats.intervals(df, "owner", "when", "key", "seconds", F.col("offset"), most)
    assert got(found, "key", "interval_s", "repetition") == sorted(want, key=repr)


@CUTS
def test_fill(df, rows, most):
    want = []
    for g in owners([(r[0], r[2] and START + datetime.timedelta(minutes=r[2]), *r[2:]) for r in rows]).values():
        known = [r[3] for r in g if r[3] is not None]
        value = known[0] if known else None
        for r in g:
            value = r[3] if r[3] is not None else value
            want.append((r[2], value))
    assert got(cleaning.fill(df, "owner", "key", "number", most), "key", "filled") == sorted(want, key=repr)


@CUTS
def test_in_order(df, rows, most):
    want = []
    for owner, g in owners(rows).items():
        top, falls = None, 0
        for r in g:
            falls += r[3] is not None and top is not None and r[3] < top
            top = r[3] if top is None else max(top, r[3] or 0)
        numbered = sum(r[3] is not None for r in g)
        want.append((owner, len(g), numbered, falls, "disordered" if falls else "gaps" if numbered < len(g) else "chronological"))
    assert got(audits.in_order(df, "owner", "when", "number", "key", most), "owner", "n", "numbered", "descents", "state") == sorted(want, key=repr)


@CUTS
@pytest.mark.parametrize("with_held", [False, True])
def test_claims(spark, df, rows, most, with_held):
    held = [(7, 3), (7, 1000), (None, 17), (101, None), (555, 9)] if with_held else []
    want = []
    for owner, g in owners(rows).items():
        taken = {n for o, n in held if o == owner and n is not None}
        free = set()
        own = {}
        for r in g:
            if r[3] is not None and r[3] not in taken | free:
                free.add(r[3])
                own[r[2]] = r[3]
        top = max(taken | free, default=0)
        for r in g:
            if r[2] not in own:
                top += 1
                own[r[2]] = top
        want += own.items()
    table = spark.createDataFrame(held, "owner long, number long") if with_held else None
    assert got(merging.claim_numbers(df.withColumnRenamed("number", "wanted"), "owner", "when", "key", "wanted", table, most), "key", "number") == sorted(want, key=repr)


@CUTS
def test_values_by_themselves(df, rows, most):
    ordered = running.Ordered(df, "owner", ["when", "key"], most)
    n = F.col("number")
    found = ordered.add(total=running.total(n), top=running.largest(n), before=running.largest(n, False), now=running.last(n), then=running.last(n, False), next=running.following(n), few=running.count(n < 50)).rows()
    want = []
    for g in owners(rows).values():
        values = [r[3] for r in g]
        for i, r in enumerate(g):
            seen, earlier, later = ([v for v in part if v is not None] for part in (values[: i + 1], values[:i], values[i:]))
            want.append((r[2], sum(seen) if seen else None, max(seen, default=None), max(earlier, default=None), seen[-1] if seen else None, earlier[-1] if earlier else None, later[0] if later else None, sum(v < 50 for v in seen)))
    assert got(found, "key", "total", "top", "before", "now", "then", "next", "few") == sorted(want, key=repr)


def test_ranges_are_even(df):
    heavy = running.Ordered(df, "owner", ["when", "key"], 60).heavy
    sizes = [r["count"] for r in heavy.groupBy(running.RANGE).count().collect()]
    assert sum(sizes) == 600 and len(sizes) >= 10 and max(sizes) <= 2 * statistics.median(sizes)
    # each range is a task of its own, and a window over it needs no further exchange
    tasks = [r["count"] for r in heavy.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sorted(tasks) == sorted(sizes)
    assert running.Ordered(df, "owner", ["when", "key"], 600).heavy is None
    assert running.Ordered(df, "owner", ["when", "key"], 10, owners=2).heavy is None
    assert running.Ordered(df.limit(0), "owner", ["when"]).rows().count() == 0


def test_longest_run(df, rows):
    want = []
    for owner, g in owners(rows).items():
        own = sorted((r for r in g if r[1] is not None and r[3] is not None), key=lambda r: (r[1], r[3], r[2]))
        best, back = [], []
        for i, r in enumerate(own):
            # the latest of the longest runs that r can follow
            fit = max(((best[j], j) for j in range(i) if own[j][3] <= r[3]), default=(0, -1))
            best.append(fit[0] + 1)
            back.append(fit[1])
        at = max(range(len(own)), key=lambda i: (best[i], i), default=-1)
        stay = set()
        while at >= 0:
            stay.add(at)
            at = back[at]
        want += [(owner, r[2]) for i, r in enumerate(own) if i not in stay]
    assert got(audits.out_of_order(df, "owner", "when", "number", "key"), "owner", "key") == sorted(want, key=repr)


def test_views_and_assignments(spark):
    views = spark.createDataFrame([(1, "a", "A", 4), (2, "a", "A", 1)], "owner long, view string, name string, position long")
    saved = spark.createDataFrame([(1, "b", 1, "B"), (1, "a", 2, "AA"), (1, "c", 3, "C"), (1, "b", 4, "BB"), (3, "z", 1, "Z"), (None, "n", 1, "N")], "owner long, view string, seq int, name string")
    assert got(state.upserted(views, saved, ["owner", "view"]), "owner", "view", "name", "position") == sorted([(1, "a", "AA", 4), (1, "b", "BB", 5), (1, "c", "C", 6), (2, "a", "A", 1), (3, "z", "Z", 1), (None, "n", "N", 1)], key=repr)
    rows = spark.createDataFrame([(k, None) for k in range(6)], "key long, trip long")
    wanted = spark.createDataFrame([(0, 1), (1, 1), (1, 1), (2, 9), (3, 9), (4, 9)], "key long, trip long")
    assert got(relations.assigned(rows, "key", "trip", wanted, 2), "key", "trip") == sorted([(0, 1), (1, 1), (2, None), (3, None), (4, None), (5, None)], key=repr)
