"""Registered queries against their SQL in DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, compare

SF = "/root/testdata/sf0.001"
TEXTS = entry.oracle_sql()
# Block variants repeat the SQL of their whole form; test_blocks covers them on skewed data.
NAMES = [n for n in TEXTS if not n.endswith("_blocked")]
EMPTY_IS_FINE = {"unprocessed_sessions", "sessions_without_events", "chosen_threshold", "best_rule"}


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("test tables are not here")
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    note, good = compare(spark, con, entry.queries()[name], TEXTS[name], SF)
    assert note.startswith("ok") and (good or name in EMPTY_IS_FINE), note


def test_registry_is_consistent():
    assert set(TEXTS) <= set(entry.queries())
