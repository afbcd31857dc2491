"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tessaloom import catalog

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def normal(frame):
    def text(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v != v:
            return "null"
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) or name == "grounding_tokens"
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
