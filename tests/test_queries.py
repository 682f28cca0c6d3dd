"""Every query that has SQL gives DuckDB's rows; the others run and keep their properties."""

import math
from pathlib import Path

import duckdb
import pytest

from facetrank.plans.oracle import ORACLE
from facetrank.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((x is None, isinstance(x, str), x if x is not None else 0) for x in row))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, db, name):
    frame = QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    mine = ordered(tuple(plain(r[c]) for c in names) for r in frame.collect())
    cursor = db.execute(ORACLE[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    rows = ordered(tuple(plain(r[theirs.index(c)]) for c in names) for r in cursor.fetchall())
    assert mine == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"graph_search"}))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
