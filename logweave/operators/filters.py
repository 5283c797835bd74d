"""Filters of a logbook: owner and live rows, local days, equalities, ranges, tags and text, from a query's parameters."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from urllib.parse import parse_qsl

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.search import ORDERS

PAGE, MOST = 50, 200


@dataclass
class LogQuery:
    """What a reader of a logbook may ask for; None or empty: not asked."""

    first_day: datetime.date | None = None
    last_day: datetime.date | None = None
    equal: dict[str, object] = field(default_factory=dict)
    least: float | None = None
    most: float | None = None
    has_profile: bool | None = None
    tags: list[str] = field(default_factory=list)
    text: str | None = None
    sort: str = "newest"
    size: int = PAGE


def parse(parameters: dict[str, str]) -> LogQuery:
    """A LogQuery from text parameters; unknown ones are ignored, unreadable ones raise ValueError."""
    p = {k: v.strip() for k, v in parameters.items() if v is not None and v.strip()}
    day = lambda k: datetime.date.fromisoformat(p[k]) if k in p else None
    number = lambda k: float(p[k]) if k in p else None
    size = int(p.get("limit", PAGE))
    if not 1 <= size <= MOST:
        raise ValueError(f"limit must be between 1 and {MOST}")
    if p.get("hasProfile", "true") not in ("true", "false"):
        raise ValueError("hasProfile is true or false")
    if p.get("sort", "newest") not in ORDERS:
        raise ValueError(f"sort is one of {', '.join(ORDERS)}")
    return LogQuery(
        first_day=day("from"), last_day=day("to"), equal={k: p[k] for k in ("site", "trip") if k in p}, least=number("minDepth"), most=number("maxDepth"),
        has_profile=None if "hasProfile" not in p else p["hasProfile"] == "true", tags=sorted({t for t in p.get("tags", "").split(",") if t}), text=p.get("q"), sort=p.get("sort", "newest"), size=size,
    )


def canonical(parameters: dict[str, str]) -> str:
    """One spelling of a saved view: known parameters but paging, sorted, lists sorted without repeats; '' if unreadable."""
    try:
        q = parse({k: v for k, v in parameters.items() if k != "limit"})
    except ValueError:
        return ""
    found = {"from": q.first_day, "to": q.last_day, **q.equal, "minDepth": q.least, "maxDepth": q.most, "hasProfile": None if q.has_profile is None else str(q.has_profile).lower(), "tags": ",".join(q.tags) or None, "q": q.text, "sort": None if q.sort == "newest" else q.sort}
    return "&".join(f"{k}={v}" for k, v in sorted(found.items()) if v is not None)


def canonical_views(df: DataFrame, view: str) -> DataFrame:
    """df with canonical: the one spelling of the query string in column `view`, '' where it cannot be read, null for null.

    A parameter given twice counts once, by its last value; escapes are read and not written back.
    """

    def spelt(text: str | None) -> str | None:
        return None if text is None else canonical(dict(parse_qsl(text.removeprefix("?"), keep_blank_values=True)))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        # saved views are few and repeat: each spelling is read once
        return texts.map({t: spelt(t) for t in texts.unique()})

    return df.withColumn("canonical", run(F.col(view)))


def totals(df: DataFrame, query: LogQuery, by: list[str], *args, **columns) -> DataFrame:
    """(by..., n): how many rows of each owner meet a query, see asked(); owners with none have no row."""
    return asked(df, query, *args, **columns).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def live(df: DataFrame, owner: str, who: object, deleted_at: str = "deleted_at") -> DataFrame:
    """One owner's rows that are not deleted."""
    return df.where((F.col(owner) == F.lit(who)) & F.col(deleted_at).isNull())


def on_days(when: Column, first: datetime.date | None, last: datetime.date | None) -> Column:
    """Local times from the first day's start to the last day's end; a null time is on no day, an open side has no bound."""
    found = when.isNotNull() if first or last else F.lit(True)
    if first:
        found = found & (when >= F.lit(first).cast("timestamp"))
    if last:
        found = found & (when < F.lit(last + datetime.timedelta(days=1)).cast("timestamp"))
    return found


def within(amount: Column, least: float | None, most: float | None) -> Column:
    """Amounts from least to most, both included; a null amount is in no range but the open one."""
    found = F.lit(True)
    if least is not None:
        found = found & F.coalesce(amount >= least, F.lit(False))
    if most is not None:
        found = found & F.coalesce(amount <= most, F.lit(False))
    return found


def mentions(needle: str, columns: list[str], lists: list[str] | None = None) -> Column:
    """Whether a text is part of one of the columns, or of an entry of one of the list columns, in any case."""
    low = F.lit(needle.lower())
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), low), F.lit(False))
    for c in lists or []:
        found = found | F.coalesce(F.exists(c, lambda x: F.coalesce(F.contains(F.lower(x), low), F.lit(False))), F.lit(False))
    return found


def asked(df: DataFrame, query: LogQuery, when: str, amount: str, texts: list[str], text_lists: list[str] | None = None, tags: str | None = None, profile: str | None = None) -> DataFrame:
    """Rows that meet all of a query; tags: an array column that must hold every asked tag."""
    found = on_days(F.col(when), query.first_day, query.last_day) & within(F.col(amount), query.least, query.most)
    for column, value in query.equal.items():
        found = found & (F.col(column) == F.lit(value))
    if query.has_profile is not None and profile:
        found = found & (F.col(profile).isNotNull() == F.lit(query.has_profile))
    if query.tags and tags:
        found = found & (F.size(F.array_intersect(F.col(tags), F.array(*[F.lit(t) for t in query.tags]))) == len(set(query.tags)))
    if query.text:
        found = found & mentions(query.text, texts, text_lists)
    return df.where(found)
