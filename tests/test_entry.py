import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry


def test_entry(spark, small, monkeypatch):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def rows(names, columns):
    return sorted(tuple(repr(v) for v in r) for r in zip(*(columns[n] for n in sorted(names))))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = entry.queries()[name](spark, small).toArrow().to_pydict()
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table().to_pydict()
    assert sorted(got) == sorted(want)
    assert rows(got, got) == rows(want, want)
