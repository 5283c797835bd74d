"""Very long cells, whole lists in the order of a language, uploads of one file again and again, series with their own times."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweave.functions import parsing
from logweave.operators import profile, search
from logweave.sources import files


def test_cells_of_a_megabyte(spark):
    long = "x" * 1_000_000
    texts = [long, f"a,{long},b", '"' + long, "'" + long + "'", f"{long}'{long}\"", "'" * 999_999, ",;" * 500_000, '""' * 500_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, c string").select("k", parsing.split_list(F.col("c")).alias("p"))
    got = {r.k: [len(x) for x in r.p] for r in rows.collect()}
    assert got == {0: [10**6], 1: [1, 10**6, 1], 2: [10**6], 3: [10**6], 4: [2 * 10**6 + 1], 5: [], 6: [], 7: []}


def test_what_a_file_is(spark):
    cases = [
        ("a.xml", "", "uddf"), ("a.txt", "plain", "unknown"), ("a.csv", "plain", "unknown"), ("a", '{"x": "y"}', "unknown"), ("a", ' {"format" : "logbook-3"', "json"), ("a", "a,b;c", "csv"), ("a", "  <a,b,c>", "unknown"),
        ("a", "<UDDF\n", "uddf"), ("a", "<uddfx>", "unknown"), ("a", "PK\x03\x04", "zip"), ("a.xlsx", "pk\x03\x04", "zip"), ("a", "pk", "unknown"), ("a", "one\r\na,b,c", "unknown"), (None, None, "unknown"), ("A.XLSX", None, "zip"), ("a", "<divelog program='subsurface'>", "subsurface"), ("a", "x" * 5000 + "<uddf>", "unknown"),
    ]
    got = spark.createDataFrame(cases, "n string, c string, want string").select("n", "c", "want", files.sniffed(F.col("n"), F.col("c")).alias("got"))
    assert [tuple(r) for r in got.where("want <> got").collect()] == []


@pytest.mark.parametrize("most", [10, 10_000])
def test_one_file_uploaded_again_and_again(spark, most):
    start = datetime(2024, 1, 1)
    rows = [(1, k, start + timedelta(minutes=k // 2), b"same", k % 3 == 0) for k in range(200)] + [(2, 900, start, b"same", False), (1, 901, start + timedelta(days=1), b"other", False), (None, 902, start, b"same", False), (None, 903, start + timedelta(days=2), b"same", True), (1, 904, None, b"same", False)]
    want = {}
    for o, b, at, c, _ in rows:
        earlier = [(a2, b2) for o2, b2, a2, c2, failed in rows if o2 == o and c2 == c and not failed and at and a2 and a2 < at]
        want[b] = max(earlier)[1] if earlier else None
    df = spark.createDataFrame(rows, "owner long, batch long, at timestamp, content binary, failed boolean").repartition(4)
    assert {r.batch: r.duplicate_of for r in files.first_uploads(df, most).collect()} == {**want, 904: None}


def test_orders_of_whole_lists(spark):
    gear = [(k, None if k % 2 else datetime(2024, 1, 1 + k % 5), n) for k, n in enumerate(["b", "B", "á", "a", "A", "Z", "z", "é"] * 60)]
    df = spark.createDataFrame(gear, "id int, retired timestamp, name string")
    got = [r.id for r in search.gear_in_order(df, "retired", "name", "id").collect()]
    rank = {n: i for i, n in enumerate(["a", "A", "á", "b", "B", "é", "z", "Z"])}
    assert got == [g[0] for g in sorted(gear, key=lambda g: (g[1] is not None, g[1] or datetime.min, rank[g[2]], g[0]))] and len(got) == 480
    counts = spark.createDataFrame([(k, k % 3) for k in range(480)], "id int, n int")
    facets = [r.id for r in search.named_facets(counts, df.select("id", "name"), "id", "name").collect()]
    assert facets == [g[0] for g in sorted(gear, key=lambda g: (-(g[0] % 3), rank[g[2]], g[0]))]
    assert search.named_facets(counts, df.select("id", "name"), "id", "name", 7).count() == 7


def test_series_with_times(spark):
    kind = "k int, t array<double>, d array<double>, c array<double>"
    rows = [
        (1, [0.0, 10.0, 10.0, 40.0, 30.0], [0.0, 20.0, 5.0, 4.0, 0.0], [20.0, 18.0, 19.0, 20.0, 20.0]),
        (2, None, None, None), (3, [], [], []), (4, [5.0], [3.0], None), (5, [0.0, 1.0], [1.0], [4.0, 5.0, 6.0]), (6, [0.0, 60.0], [10.0, 10.0], None), (7, [0.0, 30.0, 61.0], [None, 9.0, 3.0], None), (8, None, [2.0, 1.0], None),
    ]
    got = {r.k: tuple(r)[1:] for r in profile.timed_summary(spark.createDataFrame(rows, kind), "k", "t", "d", "c").collect()}
    assert got == {
        1: (5, 30.0, 20.0, 5.8, 2.0, 8, 18.0, 20.0, "time,depth,temp"),
        2: (0, 0.0, 0.0, 0.0, None, None, None, None, ""),
        3: (0, 0.0, 0.0, 0.0, None, None, None, None, "time,depth,temp"),
        4: (1, 0.0, 3.0, 3.0, None, None, None, None, "time,depth"),
        5: (3, 1.0, 1.0, 1.0, None, 1, 4.0, 6.0, "time,depth,temp"),
        6: (2, 60.0, 10.0, 10.0, 0.0, 60, None, None, "time,depth"),
        7: (3, 61.0, 9.0, 6.0, pytest.approx(6 / 31 * 60), 31, None, None, "time,depth"),
        8: (2, 0.0, 2.0, 1.5, None, None, None, None, "depth"),
    }
