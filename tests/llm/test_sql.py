"""The operators that SQL can express, against their SQL on whole tables."""

import math

import pytest

from facetrank.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(row):
    return tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    theirs = con.execute(ORACLE[name])
    columns = [c[0] for c in theirs.description]
    mine = QUERIES[name](spark, SF)
    assert sorted(mine.columns) == sorted(columns)
    assert sorted(map(plain, mine.select(*columns).collect())) == sorted(map(plain, theirs.fetchall()))
