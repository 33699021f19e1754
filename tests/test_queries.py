"""Every query of the engine against its SQL, and what has none for shape."""

import math

import duckdb
import pytest

from tests.conftest import SF

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return float(x) if type(x).__name__ == "Decimal" else x

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    ours = df.collect()
    found = db.sql(catalog.oracle_sql()[name])
    theirs = found.fetchall()
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, ours) == rows(list(found.columns), theirs)


def test_no_query_is_empty(spark, db):
    """An oracle that gives no row says nothing."""
    for name, sql in catalog.oracle_sql().items():
        assert db.sql(sql).fetchone() is not None, name


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() >= 0
    assert set(oracle_sql()) <= set(queries())
