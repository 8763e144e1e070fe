"""Every registered query with SQL gives the rows that DuckDB gives on the small tables."""

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
        want = db.sql(SQL[name])
        assert sorted(want.columns) == names
        rows = sorted(map(repr, want.select(*names).fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
