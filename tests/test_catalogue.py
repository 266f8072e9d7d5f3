"""Every core query against its SQL on the smallest tables; queries of the subpackage llm are tested beside it."""

import glob
import os

import duckdb
import pytest

from ledgerloom.plans import catalogue, problems

QUERIES = {**catalogue.QUERIES, **problems.QUERIES}
SQL = {**catalogue.SQL, **problems.SQL}


def plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def duck(small_data):
    con = duckdb.connect()
    for path in glob.glob(f"{small_data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_data, duck, name):
    df = QUERIES[name](spark, small_data)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        order = sorted(range(len(names)), key=names.__getitem__)
        assert got == sorted(str([plain(r[i]) for i in order]) for r in result.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["case_id", "field", "cand_id", "normalized_value", "rank", "candidates"]
