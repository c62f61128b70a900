import glob
import os

import duckdb
import pytest

from inkspan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal_their_sql(spark, folder, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = queries.QUERIES[name](spark, folder)
    got = sorted(map(repr, map(tuple, frame.select(*sorted(frame.columns)).collect())))
    rows = connection.sql(f"SELECT {', '.join(sorted(frame.columns))} FROM ({queries.SQL[name]})").fetchall()
    assert got == sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_all_run(spark, folder, name):
    frame = queries.QUERIES[name](spark, folder)
    assert frame.count() == frame.distinct().count()
