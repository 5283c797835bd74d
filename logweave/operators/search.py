"""Faceted search: relational division, facets, total orders and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators import running

#: Orders of a logbook: column role, whether it falls. The key breaks ties, in the same direction for times and numbers.
ORDERS = {"newest": ("when", True), "oldest": ("when", False), "deepest": ("depth", True), "longest": ("length", True), "number": ("number", True)}
MOST = 200


def having_all(df: DataFrame, owner: str, value: str, wanted: list[str]) -> DataFrame:
    """Owners with every wanted value; none wanted: no owner. Null owners count as one."""
    return df.where(F.col(value).isin(wanted)).groupBy(owner).agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(set(wanted))).select(owner)


def facets(df: DataFrame, value: str, when: str, amount: str) -> DataFrame:
    """Rows, first and last day, least and largest amount of each value, a null value included; null days and amounts do not count."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date(when)).alias("first_day"), F.max(F.to_date(when)).alias("last_day"), F.min(amount).alias("least"), F.max(amount).alias("most"))


def by_language(name: str) -> Column:
    """A name as people sort it: accents and case matter only between names equal without them (the root order of Unicode)."""
    return F.collate(F.col(name), "UNICODE")


def named_facets(counts: DataFrame, names: DataFrame, value: str, name: str, most: int | None = None) -> DataFrame:
    """All values (value, n) with their names (value, name), by falling count, then name by_language(), then value; with
    `most` only the first so many. Values without a name are left out, of several names the least counts."""
    one = names.groupBy(value).agg(F.min(name).alias(name))
    found = counts.join(one, value).orderBy(F.desc("n"), by_language(name), value)
    return found if most is None else found.limit(most)


def placed_facets(counts: DataFrame, names: DataFrame, owner: str, value: str, name: str, most: int = running.MOST) -> DataFrame:
    """(owner, value, name, n, place): each owner's values (owner, value, n) in the order of named_facets(), from 1 on."""
    one = names.groupBy(value).agg(F.min(name).alias(name))
    rows = counts.join(one, value).withColumns({"_less": -F.col("n"), "_name": by_language(name)})
    return running.Ordered(rows, owner, ["_less", "_name", value], most).add(place=running.count()).rows().select(owner, value, name, "n", "place")


def page(df: DataFrame, amount: str, key: str, size: int = 50, after: tuple[float | None, int] | None = None) -> DataFrame:
    """One page of rows by falling amount (nulls last), then key, after the last row (amount, key) of the page before."""
    if not 1 <= size <= MOST:
        raise ValueError(f"a page has 1 to {MOST} rows")
    if after is not None:
        value, last = after
        a, k = F.col(amount), F.col(key)
        df = df.where(a.isNull() & (k > last) if value is None else (a < value) | ((a == value) & (k > last)) | a.isNull())
    return df.orderBy(F.desc_nulls_last(amount), key).limit(size)


def page_and_more(df: DataFrame, amount: str, key: str, size: int = 50, after: tuple[float | None, int] | None = None) -> DataFrame:
    """A page as page() gives it, each row with has_more: whether another page follows. One row more than the page is read."""
    if not 1 <= size <= MOST - 1:
        raise ValueError(f"a page that looks ahead has 1 to {MOST - 1} rows")
    rows = page(df, amount, key, size + 1, after)
    names = [F.col(f"r.`{c}`").alias(c) for c in df.columns]
    # at most MOST rows
    held = rows.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("all"))
    order = F.array_sort("all", lambda x, y: F.when(x[amount].eqNullSafe(y[amount]), F.when(x[key] < y[key], -1).otherwise(1)).when(x[amount].isNull(), 1).when(y[amount].isNull(), -1).when(x[amount] > y[amount], -1).otherwise(1))
    return held.select(F.explode(F.slice(order, 1, size)).alias("r"), (F.size("all") > size).alias("has_more")).select(*names, "has_more")


def ordered(df: DataFrame, order: str, columns: dict[str, str], key: str, most: int = MOST) -> DataFrame:
    """The first `most` rows in one of ORDERS, nulls last; columns: role to column name."""
    role, falls = ORDERS[order]
    first = F.desc_nulls_last(columns[role]) if falls else F.asc_nulls_last(columns[role])
    return df.orderBy(first, F.desc(key) if falls and role in ("when", "number") else F.asc(key)).limit(most)


def trips_in_order(df: DataFrame, start: str, made: str, key: str, most: int | None = None) -> DataFrame:
    """All trips (with `most`, the first so many) by falling start day, those without one last, then by falling time of
    making, ties by key."""
    found = df.orderBy(F.desc_nulls_last(start), F.desc_nulls_last(made), key)
    return found if most is None else found.limit(most)


def gear_in_order(df: DataFrame, retired: str, name: str, key: str, most: int | None = None) -> DataFrame:
    """All gear (with `most`, the first so many): what is in use, then retired gear by rising day, each by name, ties by key."""
    found = df.orderBy(F.asc_nulls_first(retired), by_language(name), key)
    return found if most is None else found.limit(most)
