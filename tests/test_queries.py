"""Registered queries against their SQL on the smallest tables. ALL_QUERIES=1 runs every one."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SOME = ["E00_file_to_status", "F24_document_key", "R02_page_results", "E16_sample_random", "B01_balance_records", "J00_scored_journal", "J23_score_without_criterion", "Q01_sequence_missing", "X01_over_limit_events", "S13_drop_identical_rows", "E01_assemble_entries",
        "E10_duplicate_entries", "E20_quick_reversals", "D05_classify_documents", "V03_section_status", "B05_bank_check"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(contract.queries()) if os.environ.get("ALL_QUERIES") else SOME)
def test_query_matches_sql(spark, sql, name):
    df = contract.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in contract.oracle_sql():
        cur = sql.execute(contract.oracle_sql()[name])
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_entry_point_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 155 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(contract.__file__), timeout=120)
