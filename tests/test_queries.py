"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lexigrove.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.7g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value if value is None or isinstance(value, (str, bool)) else f"{float(value):.7g}" if isinstance(value, (int,)) else str(value)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, con, name):
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    frame = registry.QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(frame.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in frame.select(*names).collect())
    assert got == sorted(repr(tuple(map(plain, r))) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
