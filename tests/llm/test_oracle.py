"""The queries that SQL can express, on the whole small tables."""

import duckdb
import pytest

from lamina.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(map(tuple, QUERIES[name](spark, SF).select(*columns).collect())) == sorted(found.fetchall())
