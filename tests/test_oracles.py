"""Every query with a DuckDB equivalent gives the same rows on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(columns, found):
    return sorted(repr(tuple(plain(x) for x in r)) for r in found)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_duckdb(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows(columns, df.select(*columns).collect())
    if name not in registry.ORACLE_SQL:
        assert got is not None
        return
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    assert got == rows(columns, rel.project(",".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()
    assert os.path.exists(entry.SMOKE_DIR)
