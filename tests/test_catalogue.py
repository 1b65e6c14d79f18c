"""Each query against the SQL that says the same, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sahifa.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(rows):
    def one(x):
        return None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else tuple(map(one, x)) if isinstance(x, (list, tuple)) else x

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df, sql = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    names = sorted(df.columns)
    places = [sql.columns.index(n) for n in names]
    assert plain(df.select(*names).collect()) == plain([tuple(r[i] for i in places) for r in sql.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0
