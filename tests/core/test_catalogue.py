"""Every query of the engine's own catalogue against its SQL in DuckDB."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from quire import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def shown(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = shown(df.select(*cols).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == cols
    assert got == shown(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
