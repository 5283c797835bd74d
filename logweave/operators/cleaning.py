"""Cleaning of parsed values: range rules and the roll-up of what they found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators import running


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Nulls values out of range and appends an issue (code, field) to the column issues for each."""
    bad = F.col(column).isNotNull() & ~F.col(column).between(low, high)
    issue = F.array(F.struct(F.lit("out_of_range").alias("code"), F.lit(column).alias("field")))
    before = F.col("issues") if "issues" in df.columns else F.array().cast("array<struct<code:string,field:string>>")
    return df.withColumn("issues", F.when(bad, F.concat(before, issue)).otherwise(before)).withColumn(column, F.when(~bad, F.col(column)))


def issue_rollup(df: DataFrame, kind: str, key: str) -> DataFrame:
    """For each issue code: how often, in how many kinds of row, and the first row with it."""
    rows = df.select(kind, key, F.explode("issues").alias("i"))
    return rows.groupBy(F.col("i.code").alias("code"), F.col("i.field").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(kind).alias("kinds"), F.min(key).alias("first_key"))


def fill(df: DataFrame, owner: str, order: str, column: str, most: int = running.MOST) -> DataFrame:
    """Adds filled: the last known value carried forward, and the first one back to leading nulls; null if there is none."""
    known = F.col(column)
    rows = running.Ordered(df, owner, [order], most).add(_back=running.last(known), _ahead=running.following(known)).rows()
    return rows.withColumn("filled", F.coalesce("_back", "_ahead")).drop("_back", "_ahead")
