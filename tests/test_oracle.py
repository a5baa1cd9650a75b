"""Every query of the catalog against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from weftline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def value(v):
    if pd.isna(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(value(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    assert rows(got) == rows(con.sql(sql).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
