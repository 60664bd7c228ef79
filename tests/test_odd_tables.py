"""Queries on small tables that the given ones don't show: repeated contents and names, equal vectors, against their SQL."""

import duckdb
import pytest

from estrado import catalog
from estrado.operators import parties

from .test_catalog import rows


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query gives its SQL's rows on tables of these rows: a name and a query of DuckDB each."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"create table {t} as {sql}")
            con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
        want = con.execute(catalog.ORACLE[name]).df()
        got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert len(want) and rows(got) == rows(want)

    return check


def test_a_picture_is_described_if_its_first_page_is(agrees):
    """One url on pages 3 and 10, one on 20 and 21: the first stays, whatever page 10 says of it, the second goes."""
    agrees("image_filter", pages="SELECT unnest([3, 10, 20, 21, 30, 33]) page_id, unnest(['a', 'a', 'b', 'b', 'c', 'd']) url, repeat('x', 1100) html")



@pytest.mark.parametrize("name", ["party_cascade", "attach_parties"])
def test_numbers_that_read_as_a_lone_i(agrees, tiny, name):
    """Customers whose number in letters is I, which registries leave out of names, beside those of the given table."""
    add = "SELECT 41432 + i * 100000 c_custkey, 'Customer' c_name, (i * 7 % 25)::INTEGER c_nationkey, 0.0 c_acctbal, 'HOUSEHOLD' c_mktsegment FROM (SELECT unnest(range(0, 12)) i)"
    agrees(name, customer=f"SELECT * FROM '{tiny}/customer.parquet' UNION ALL {add}")


@pytest.mark.parametrize("name", ["party_cascade", "attach_parties"])
def test_no_roster_goes_to_every_task(spark, tiny, monkeypatch, name):
    """Whatever Spark takes for small: the variants of names count as one row each in its estimates."""
    monkeypatch.setattr(parties, "written", lambda df, _: df)
    plan = catalog.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
