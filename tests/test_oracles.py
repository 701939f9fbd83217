"""Every query with SQL gives DuckDB's rows."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from veriquill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    show = lambda v: "null" if v is None or v is pd.NaT or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """Queries without SQL give rows; what is in them is held against plain Python in tests of their own."""
    assert QUERIES[name](spark, SF).count() > 0
