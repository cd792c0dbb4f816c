"""The registered queries against their SQL, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__ as E
from schemawake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(repr(round(x, 6) if isinstance(x, float) else x) for x in r) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = plain(df.select(*sorted(df.columns)).collect())
    rel = duck.sql(ORACLES[name])
    want = plain(duck.sql("SELECT " + ", ".join(f'"{c}"' for c in sorted(rel.columns)) + " FROM rel").fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want and got


def test_entry(spark):
    assert E.entry(spark).columns and set(E.oracle_sql()) <= set(E.queries())
    assert set(ORACLES) == set(QUERIES)
