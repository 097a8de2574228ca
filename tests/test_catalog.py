"""Every query of the catalog against its SQL."""

import duckdb
import pytest

import __spark_entry__
from lamina.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: "nan" if x != x else repr(round(x, 9)) if isinstance(x, float) else str(x)
    return sorted(tuple(value(r[i]) for i in order) for r in rows), sorted(columns)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    found = oracle.execute(catalog.ORACLE[name])
    assert _rows(df.collect(), df.columns) == _rows(found.fetchall(), [d[0] for d in found.description])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
