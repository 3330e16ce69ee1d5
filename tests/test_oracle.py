"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import registry


def rounded(v):
    return (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(rounded(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert {"scope", "contracts", "nft_ratio"} <= set(entry.entry(spark).columns)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
