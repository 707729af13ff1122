"""Every query of the library against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from meterflow.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{Path(data, 'sf0.001', t)}.parquet'")
    return con


def shaped(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(lambda x: "null" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else f"{x:.9g}" if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(name, spark, data, db):
    got = catalog.QUERIES[name](spark, f"{data}/sf0.001").toPandas()
    pd.testing.assert_frame_equal(shaped(got), shaped(db.sql(catalog.ORACLE_SQL[name]).df()))


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry_without_extras(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
