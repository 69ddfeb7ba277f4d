"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tools.check_oracle import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.01"
ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES + ["events"]:
        c.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows, cols = df.collect(), df.columns
    assert len(cols) == len(set(cols))
    if name not in ORACLE:
        assert len(rows) > 0
        return
    rel = con.execute(ORACLE[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(ocols)
    assert rows_of(cols, rows) == rows_of(ocols, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_entry_schema_is_stable(spark):
    a, b = E.entry(spark), E.entry(spark)
    assert a.schema == b.schema and a.count() == b.count() > 0
