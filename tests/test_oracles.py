"""Every query with an oracle equals DuckDB on the smallest tables; the others return rows."""

from __future__ import annotations

from pathlib import Path

import pytest

from siteward import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    import pandas as pd

    df = df.reindex(sorted(df.columns), axis=1)
    plain = lambda v: v if isinstance(v, str) else None if pd.isna(v) else float(v)
    return sorted([tuple(map(plain, r)) for r in df.itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    mine = catalog.queries()[name](spark, str(DATA)).toPandas()
    theirs = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_returns_rows(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).count() > 0
