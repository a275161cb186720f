"""Every query that has SQL gives the same rows as the SQL does."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from plumbline.plans import queries as plans

DATA = "/root/testdata"
SMALL = f"{DATA}/sf0.001"


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        if isinstance(x, pd.Timestamp):
            return x.isoformat()
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SMALL)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SMALL).toPandas()
    if name in plans.ORACLE_SQL:
        want = duck.execute(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 10 and df.columns[:2] == ["entity", "display"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
