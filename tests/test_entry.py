import duckdb
import pytest

import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["top_indicators", "indicator_statistics", "extract_email", "sliding_chunks", "route_queries", "p6_found", "related_n_hop"])
def test_queries_equal_their_sql(spark, folder, name):
    import glob
    import os

    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = entry.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect())))
    expected = connection.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, expected))
