"""Every named query against its SQL twin on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from driftspark.plans import oracles
from driftspark.plans import queries as catalog

QUERIES, ORACLES = catalog.queries(), oracles.oracle_sql()

# Reference figures for the flagship query at sf0.01: psi, euclidean, pearson.
GOLDEN = {
    "A": (0.00178391, 0.01347042, 0.92260366),
    "N": (0.00092397, 0.0137516, 0.9190553),
    "R": (0.00257037, 0.01212426, 0.93590207),
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    return sorted([tuple(plain(r[i]) for i in order) for r in records], key=repr)


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    assert found == rows(columns, cursor.fetchall())
    assert found


def test_flagship_golden(spark):
    df = QUERIES["drift_report"](spark, "/root/testdata/sf0.01")
    for r in df.filter("metric = 'extendedprice'").collect():
        assert (r["psi"], r["euclidean"], r["pearson"]) == GOLDEN[r["submetric"]]


def test_entry_has_a_stable_schema(spark):
    names = ["metric", "submetric", "psi", "pearson", "euclidean", "degenerate"]
    assert contract.entry(spark).columns == names
