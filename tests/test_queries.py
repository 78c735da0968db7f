"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, D).toArrow()
    duck.register("got", got)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {entry.oracle_sql()[name]}")
    want = duck.sql("SELECT * FROM want")
    assert sorted(got.column_names) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    columns = ", ".join(f'round("{c}", 6)' if kinds[c] == "DOUBLE" else f'"{c}"' for c in sorted(kinds))
    for a, b in (("got", "want"), ("want", "got")):
        assert duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []
