"""Every registered query against its SQL twin, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from yearweave.plans.catalog import QUERIES
from yearweave.plans.oracles import ORACLES

TABLES = [p.stem for p in sorted(Path("/root/testdata/sf0.001").glob("*.parquet"))]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else str(v)

    return sorted((tuple(text(r[i]) for i in order) for r in rows), key=str)


def test_registry_is_complete():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = canonical(df.collect(), df.columns)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == canonical(cursor.fetchall(), columns)
