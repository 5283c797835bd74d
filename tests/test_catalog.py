"""Every registered query against its SQL on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from logweave.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if pd.isna(v):
            return None
        if hasattr(v, "isoformat"):
            return str(v)[:10]
        return round(float(v), 4) + 0.0 if not isinstance(v, str) else v

    names = sorted(df.columns)
    return [names, *sorted(([plain(v) for v in r] for r in df[names].astype(object).itertuples(index=False)), key=repr)]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    mine, theirs = rows(catalog.QUERIES[name](spark, FOLDER).toPandas()), rows(duck.execute(catalog.ORACLE_SQL[name]).df())
    assert mine[0] == theirs[0]
    assert len(mine) == len(theirs)
    assert [x for x, y in zip(mine, theirs, strict=True) if x != y][:3] == [y for x, y in zip(mine, theirs, strict=True) if x != y][:3]
