"""Queries on the smallest tables, against their SQL where they have one."""

import duckdb
import pytest

from ledgerloom.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["case_id", "field", "cand_id"], "p2_found": ["cand_id", "field"], "p5_found": ["tab", "rec_key", "page", "line"],
    "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_data, name):
    df = QUERIES[name](spark, small_data)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and rows and len(rows) == len(set(rows))
    if name in SQL:
        con = duckdb.connect()
        for table in ("candidates", "source_authority", "documents", "eval_items"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_data}/{table}.parquet'")
        assert sorted(rows) == sorted(con.execute(SQL[name]).fetchall())
