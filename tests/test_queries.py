"""Every query of the engine against its SQL, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__
from mosaiq.plans import registry

SF = os.environ.get("MOSAIQ_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(name, spark, duck):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(norm(r[k]) for k in at) for r in found.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
