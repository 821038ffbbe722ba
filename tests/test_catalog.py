"""Every registered query against DuckDB on the smallest tables, as the driver compares them."""

from __future__ import annotations

import math

import duckdb
import pytest

from vellum.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: These take long on small machines and have their own tests below or are parts of others.
SLOW = {"bundle_provenance", "pagerank_personalized"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_equals_duckdb(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert got == want


def test_code_is_masked(spark, sf):
    got = {r["path"]: r["links"] for r in catalog.QUERIES["code_mask"](spark, sf).collect()}
    assert got == {"inline": "b", "fence": "b", "tilde": "b", "escaped": "b", "open": "b"}
