"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quern import durable, queries

QUERIES, ORACLES = queries.QUERIES | durable.QUERIES, queries.ORACLES | durable.ORACLES


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or isinstance(value, (float, np.floating)) and math.isnan(value):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    return repr(round(float(value), 6)) if isinstance(value, (int, float, np.number)) else str(value)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, tables, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), tables.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))
    assert key(got) == key(want)
