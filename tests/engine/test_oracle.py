"""Every registered query against its SQL twin, and rows for those without one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from slatework.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(name, spark, sf, duck):
    df = catalogue.QUERIES[name](spark, sf)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_without_sql(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
