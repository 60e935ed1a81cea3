"""Every graph query against its SQL, run by DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from ramify.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert set(oracles.oracle_sql()) == set(queries.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_same_rows(spark, db, name):
    df = queries.queries()[name](spark, SF)
    own = df.toPandas()
    want = db.execute(oracles.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(want.columns)
    columns = sorted(own.columns)
    rows = lambda x: sorted(map(tuple, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()), key=repr)
    mine, theirs = rows(own), rows(want)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a == b


def test_entry(spark):
    assert entry.entry(spark).first()["triangles"] == 125_968
