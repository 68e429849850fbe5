"""Every SQL text of the corpus operators ends in good time."""

import os
import threading

import duckdb
import pytest

from strandloom.llm.queries import oracle_sql

SF = "/root/testdata/sf0.01"
SECONDS = 60


@pytest.mark.parametrize("name", oracle_sql())
def test_sql_ends(name):
    duck = duckdb.connect()
    for table in os.listdir(SF):
        duck.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    stop = threading.Timer(SECONDS, duck.interrupt)
    stop.start()
    try:
        duck.execute(oracle_sql()[name]).fetchmany(1)
    finally:
        stop.cancel()
