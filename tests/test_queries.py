"""Every registered query of the engine against its SQL in DuckDB over whole tables."""

import math

import duckdb
import pytest

from lumenfold.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    assert name in ORACLES
    df = QUERIES[name](spark, SF)
    found = db.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in df.columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str) == want
