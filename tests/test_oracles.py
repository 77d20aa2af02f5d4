"""Every core query with an SQL equivalent, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from siftspark.plans import registry

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    out = con.execute(registry.oracle_sql()[name])
    given = [d[0] for d in out.description]
    assert sorted(given) == columns
    want = sorted((tuple(plain(r[given.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
    assert got == want
