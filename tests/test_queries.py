"""Every query that has SQL gives the rows of the SQL."""

import duckdb
import pytest

from lexloom.plans import catalogue, oracle

TABLES = "documents benchmark".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query(spark, duck, sf_dir, name):
    ours = catalogue.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.sql(oracle.ORACLE[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).values.tolist()), key=repr)
    assert rows(ours) == rows(theirs)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
