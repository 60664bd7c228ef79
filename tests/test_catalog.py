"""Each query that SQL can express against its SQL, on the smallest tables; the rest must give rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from estrado import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{tiny}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else f"{v:.6f}"
    return str(v)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tiny, duck, name):
    got = catalog.QUERIES[name](spark, tiny).toPandas()
    if name in catalog.ORACLE:
        want = duck.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
