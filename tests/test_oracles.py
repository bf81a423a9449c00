"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from boutline.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    columns = sorted(frame.columns)

    def value(v):
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return None
        try:
            return round(float(v), 5) + 0.0
        except (TypeError, ValueError):
            return str(v)

    rows = [tuple(value(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return columns, sorted(rows, key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf, name)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = canonical(QUERIES[name](spark, sf).toPandas()), canonical(duck.sql(ORACLES[name]).df())
    assert got[0] == want[0]
    assert want[1], "no rows to compare"
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert math.isfinite(len(QUERIES))
