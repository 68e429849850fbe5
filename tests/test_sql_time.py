"""Every SQL text ends in good time on tables ten times those that the other tests read."""

import os
import threading

import duckdb
import pytest

from strandloom.queries import SQL

SF = "/root/testdata/sf0.01"
SECONDS = 60


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", SQL)
def test_sql_ends(duck, name):
    stop = threading.Timer(SECONDS, duck.interrupt)
    stop.start()
    try:
        duck.execute(SQL[name]).fetchmany(1)
    finally:
        stop.cancel()
