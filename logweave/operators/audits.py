"""Audits of sequences: rows out of order, numbering, and columns that follow from other columns."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators import running


def in_order(df: DataFrame, owner: str, when: str, number: str, key: str, most: int = running.MOST) -> DataFrame:
    """(owner, n, numbered, descents, state): whether numbers never fall along time (ties by key).

    State: chronological if all rows have a number and none falls, gaps if some lack one and none falls, else disordered.
    Owners with more than `most` rows are read in ranges.
    """
    rows = running.Ordered(df.select(owner, when, key, number), owner, [when, key], most).add(_top=running.largest(F.col(number), False)).rows()
    marked = rows.select(owner, number, F.coalesce(F.col(number) < F.col("_top"), F.lit(False)).alias("falls"))
    got = marked.groupBy(owner).agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("numbered"), F.count_if("falls").alias("descents"))
    return got.withColumn("state", F.when(F.col("descents") > 0, "disordered").when(F.col("numbered") < F.col("n"), "gaps").otherwise("chronological"))


def piles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds pile to rows in order of owner and time: how many rows a longest non-falling run up to this one has before it.

    Kept from row to row: the least number that ends a run of each length, which is never more than the longest run.
    """
    whose, tails = None, []
    for batch in batches:
        found = []
        for owner, v in zip(batch.column("owner").to_pylist(), batch.column("number").to_pylist(), strict=True):
            if owner != whose:
                whose, tails = owner, []
            k = bisect_right(tails, v)
            tails[k : k + 1] = [v]
            found.append(k)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "pile"])


def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that one longest run leaves out, of rows with their pile and their owner's largest, from the last back.

    The run's row of a pile is the latest one before the run's row of the next pile.
    """
    whose, want = object(), 0
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("owner", "pile", "longest"))
        for owner, pile, longest in zip(*columns, strict=True):
            if owner != whose:
                whose, want = owner, longest
            out.append(pile != want)
            want -= pile == want
        yield pa.RecordBatch.from_arrays([batch.column("owner"), batch.column("key")], ["owner", "key"]).filter(pa.array(out, pa.bool_()))


def out_of_order(df: DataFrame, owner: str, when: str, number: str, key: str) -> DataFrame:
    """(owner, key) of the rows beside one longest non-decreasing run of numbers along time (ties by number, then key).

    Rows without a number or a time take no part; a null owner is one. The run is a property of an owner's whole sequence,
    so that is read in one task, forward and then back, but never held: Spark sorts it, on disk if need be, and a task keeps
    no more than the ends of runs. Tasks read many owners one after the other.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(owner).alias("owner"), F.col(key).alias("key"), F.col(when).alias("when"), F.col(number).alias("number")).where("number is not null and when is not null")
    order = ["when", "number", "key"]
    sorted_ = rows.repartition("owner").sortWithinPartitions("owner", *order)
    piled = sorted_.mapInArrow(piles, f"owner {kinds[owner]}, key {kinds[key]}, when {kinds[when]}, number {kinds[number]}, pile long")
    back = [F.desc(c) for c in order]
    whole = Window.partitionBy("owner").orderBy(*back).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = piled.withColumn("longest", F.max("pile").over(whole)).sortWithinPartitions("owner", *back)
    found = last.mapInArrow(beside, f"owner {kinds[owner]}, key {kinds[key]}")
    return found.select(F.col("owner").alias(owner), F.col("key").alias(key))


#: Kinds of derivation, in the order in which one is told before another.
DERIVED = ["cumulative", "sum", "difference"]


def derived_columns(df: DataFrame, group: str, order: str, columns: list[str], eps: float = 1e-6, tried: int = 8, most: int = running.MOST) -> DataFrame:
    """(group, column, kind, from_a, from_b): columns that follow from others on every row of their group (a file, say).

    cumulative: the running total of another one in the given order; sum and difference: of two others. Values agree within
    eps of the larger size, and at least three rows must be compared; nulls take no part. A column is told once: cumulative
    before sum before difference, and no difference is told by columns that are derived themselves.

    All derivations are tried on a group's first `tried` rows, inside one row of the plan whatever the number of columns;
    only those that no such row contradicts are counted over all rows.
    """
    n = len(columns)
    rows = df.select(group, order, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    run = running.Ordered(rows, group, [order], most).add(_n=running.count(), **{f"_t{i}": running.total(F.col(f"_v{i}")) for i in range(n)}).rows()
    totals = [F.when(F.col(f"_v{i}").isNotNull(), F.col(f"_t{i}")) for i in range(n)]
    held = run.select(F.col(group).alias("g"), "_n", F.array(*[F.col(f"_v{i}") for i in range(n)]).alias("v"), F.array(*totals).alias("t"))

    def holds(row: Column, d: Column) -> Column:
        """Whether a row agrees with a derivation (kind, c, a, b), null where it cannot tell."""
        v = lambda i: F.get(row["v"], i)
        x = v(d["c"])
        y = F.when(d["kind"] == 0, F.get(row["t"], d["a"])).when(d["kind"] == 1, v(d["a"]) + v(d["b"])).otherwise(v(d["a"]) - v(d["b"]))
        return F.abs(x - y) <= eps * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))

    every = F.sequence(F.lit(0), F.lit(n - 1))
    derivation = lambda kind, c, a, b: F.struct(F.lit(kind).alias("kind"), c.alias("c"), a.alias("a"), b.alias("b"))
    pairs = lambda keep, make: F.flatten(F.transform(every, lambda a: F.transform(F.filter(every, lambda b: keep(a, b)), lambda b: make(a, b))))
    totals_of = pairs(lambda c, a: c != a, lambda c, a: derivation(0, c, a, F.lit(-1)))
    of_two = lambda kind, keep: F.flatten(F.transform(every, lambda c: pairs(lambda a, b: keep(a, b) & (a != c) & (b != c), lambda a, b: derivation(kind, c, a, b))))
    tests = F.concat(totals_of, of_two(1, lambda a, b: a < b), of_two(2, lambda a, b: a != b))

    first = held.where(F.col("_n") <= tried).groupBy("g").agg(F.collect_list(F.struct("v", "t")).alias("first")).where(F.size("first") >= 3)
    open_ = first.select("g", F.explode(F.filter(tests, lambda d: F.forall("first", lambda row: F.coalesce(holds(row, d), F.lit(True))))).alias("d"))
    same = F.col("h.g").eqNullSafe(F.col("o.g"))
    counted = held.alias("h").join(open_.alias("o"), same).select("h.g", "o.d", holds(F.struct("h.v", "h.t"), F.col("o.d")).alias("ok"))
    sure = counted.groupBy("g", "d").agg(F.count_if("ok").alias("y"), F.count_if(~F.col("ok")).alias("n")).where("n = 0 and y >= 3")

    # in the order of telling: running totals, then for each column its sums and differences by the first of the two
    place = F.struct((F.col("d.kind") > 0).alias("late"), F.col("d.c").alias("c"), F.col("d.a").alias("a"), F.col("d.kind").alias("kind"), F.col("d.b").alias("b"))
    hits = sure.groupBy("g").agg(F.array_sort(F.collect_list(place)).alias("hits"))
    firm = F.filter("hits", lambda h: (h["kind"] < 2) & ~F.exists("hits", lambda o: (o["kind"] < 2) & (o["c"] == h["c"]) & (F.struct(o["kind"] > 0, o["a"], o["b"]) < F.struct(h["kind"] > 0, h["a"], h["b"]))))
    told = hits.select("g", "hits", firm.alias("firm")).withColumn("done", F.transform("firm", lambda h: h["c"]))
    among = lambda i: F.array_contains("done", i)
    loose = F.filter("hits", lambda h: (h["kind"] == 2) & ~among(h["c"]) & ~among(h["a"]) & ~among(h["b"]))
    # a difference that is told takes its column from the evidence of the later ones
    told = told.withColumn("loose", loose)
    none = F.slice("hits", 1, 0)
    taken = lambda acc, i: F.exists(acc, lambda y: y["c"] == i)
    kept = F.aggregate("loose", none, lambda acc, h: F.when(taken(acc, h["c"]) | taken(acc, h["a"]) | taken(acc, h["b"]), acc).otherwise(F.concat(acc, F.array(h))))
    names, kinds = F.array(*map(F.lit, columns)), F.array(*map(F.lit, DERIVED))
    out = told.select(F.col("g").alias(group), F.explode(F.concat("firm", kept)).alias("h"))
    return out.select(group, F.get(names, F.col("h.c")).alias("column"), F.get(kinds, F.col("h.kind")).alias("kind"), F.get(names, F.col("h.a")).alias("from_a"), F.when(F.col("h.b") >= 0, F.get(names, F.col("h.b"))).alias("from_b"))
