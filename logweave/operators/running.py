"""Values that run along each owner's rows, also where one owner holds a large share of all rows.

A window sorts an owner's rows in one task. Owners with more rows than a task should sort are cut into ranges of their
order instead: their rows are dealt by range and written, the value is worked out within each range, one small row a range
says what the range adds, and a running sum of these rows is brought back to the range's own rows. Numbers, sums, largest,
last and next values can all be put together like that.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from logweave.sources.shared import written

#: Rows of one owner that a task sorts at the most, unless the table has more than OWNERS times as many.
MOST = 1_000_000
#: Owners that are cut into ranges at the most; their ranges, of half a task's rows, are at most three times as many.
OWNERS = 10_000
RANGE = "__range"


class Running(NamedTuple):
    """A value along rows: within a window, of all rows of a range, over other ranges' values, and put together."""

    local: Callable[[WindowSpec], Column]
    whole: Callable[[list[str]], Column]
    carried: Callable[[Column, WindowSpec], Column]
    both: Callable[[Column, Column], Column]


def _up_to(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _later(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def count(condition: Column | None = None) -> Running:
    """Rows up to this one, itself included (that meet a condition)."""
    c = F.lit(True) if condition is None else condition
    return Running(lambda w: F.count_if(c).over(_up_to(w)), lambda _: F.count_if(c), lambda x, w: F.sum(x).over(_earlier(w)), lambda a, b: a + F.coalesce(b, F.lit(0).cast("long")))


def total(value: Column) -> Running:
    """Sum of the known values up to this row; null before the first one."""
    return Running(lambda w: F.sum(value).over(_up_to(w)), lambda _: F.sum(value), lambda x, w: F.sum(x).over(_earlier(w)), lambda a, b: F.coalesce(a + b, a, b))


def largest(value: Column, itself: bool = True) -> Running:
    """Largest known value up to this row, or of the rows before it."""
    frame = _up_to if itself else _earlier
    return Running(lambda w: F.max(value).over(frame(w)), lambda _: F.max(value), lambda x, w: F.max(x).over(_earlier(w)), lambda a, b: F.greatest(a, b))


def last(value: Column, itself: bool = True) -> Running:
    """Last known value up to this row, or of the rows before it."""
    frame = _up_to if itself else _earlier
    of = lambda order: F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return Running(lambda w: F.last(value, True).over(frame(w)), of, lambda x, w: F.last(x, True).over(_earlier(w)), lambda a, b: F.coalesce(a, b))


def following(value: Column) -> Running:
    """First known value from this row on."""
    of = lambda order: F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))
    ahead = lambda w: w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return Running(lambda w: F.first(value, True).over(ahead(w)), of, lambda x, w: F.first(x, True).over(_later(w)), lambda a, b: F.coalesce(a, b))


class Ordered:
    """The rows of df in the order of their owner: by the columns of `order`, rising and nulls first.

    Rows equal in owner and order stay in one range; what they come out with is only defined as a set. A null owner is one.
    """

    def __init__(self, df: DataFrame, owner: str, order: list[str], most: int = MOST, owners: int = OWNERS):
        self.owner, self.order = owner, order
        self.light, self.heavy = df, None
        sizes = df.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
        every, top = sizes.agg(F.sum("n"), F.max("n")).first()
        bound = max(most, (every or 0) // owners)
        if (top or 0) <= bound:
            return
        # at most `owners` rows, as each has more than that part of all rows
        busy = sizes.where(F.col("n") > bound).select(F.col(owner).alias("_busy"), F.col("n").alias("_n"))
        rows = busy.agg(F.sum("_n")).first()[0]
        same = df[owner].eqNullSafe(busy["_busy"])
        ranges = math.ceil(2 * rows / bound)
        dealt = df.join(F.broadcast(busy.select("_busy")), same, "left_semi").repartitionByRange(ranges, owner, *order)
        # the number of a row's range is written with it: ranges dealt anew could have other borders
        self.heavy = written(dealt.withColumn(RANGE, F.spark_partition_id())).repartitionByRange(ranges, RANGE)
        self.light = df.join(F.broadcast(busy.select("_busy")), same, "left_anti")

    def add(self, **values: Running) -> Ordered:
        """Adds a column for each value."""
        w = Window.partitionBy(self.owner).orderBy(*self.order)
        self.light = self.light.withColumns({k: v.local(w) for k, v in values.items()})
        if self.heavy is not None:
            sums = self.heavy.groupBy(self.owner, RANGE).agg(*[v.whole(self.order).alias(k) for k, v in values.items()])
            across = Window.partitionBy(self.owner).orderBy(RANGE)
            carried = sums.select(F.col(self.owner).alias("_owner"), F.col(RANGE).alias("_range"), *[v.carried(F.col(k), across).alias(f"_{k}") for k, v in values.items()])
            here = Window.partitionBy(self.owner, RANGE).orderBy(*self.order)
            local = self.heavy.withColumns({k: v.local(here) for k, v in values.items()})
            found = local.join(F.broadcast(carried), F.col(self.owner).eqNullSafe(F.col("_owner")) & (F.col(RANGE) == F.col("_range")))
            self.heavy = found.withColumns({k: v.both(F.col(k), F.col(f"_{k}")) for k, v in values.items()}).drop("_owner", "_range", *[f"_{k}" for k in values])
        return self

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Changes rows one by one: change() may add columns, nothing else."""
        self.light = change(self.light)
        if self.heavy is not None:
            self.heavy = change(self.heavy)
        return self

    def rows(self) -> DataFrame:
        return self.light if self.heavy is None else self.light.unionByName(self.heavy.drop(RANGE))
