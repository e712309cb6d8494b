"""Each registered query of the geospatial operators against its DuckDB text on the smallest tables."""

import math
import os

import duckdb
import pytest

from tesserax.plans import registry

SF = "/root/testdata/sf0.001"
SQL, QUERIES = registry.oracle_sql(), registry.queries()


def plain(v):
    if v is None or isinstance(v, bool | str):
        return str(v)
    if isinstance(v, int):
        return str(v)
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(f) else f"{f:.9g}" if f else "0"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.sql(SQL[name])
    assert sorted(expected.columns) == columns
    own = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    assert own == sorted(tuple(map(plain, r)) for r in con.sql(f"select {names} from ({SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
