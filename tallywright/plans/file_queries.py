"""One run from the lines of journal files to the status of the entry tests (E00)."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.functions.parsing import amount_lenient, date_lenient
from tallywright.functions.tables import StoredTable, constant_table
from tallywright.operators import anomalies as A, entries as E, entry_layout as L, reporting as P, sampling as S
from tallywright.plans import entry_queries  # noqa: F401  (defines the views of the entry tests)
from tallywright.plans.views import define_shared, shared, with_views
from tallywright.sources import delimited as D

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Two files, read into one engagement. Entry numbers stand on some lines only, some descriptions hold a separator, a quote
# and a line break (a record of two lines), some are blank, and some lines have no account.
define_shared("file_lines", "events", """
SELECT source_id, line_number, value FROM (
 SELECT concat('S', CAST(user_id % 2 AS STRING)) AS source_id, event_id * 2 + 1 AS line_number,
  concat(CASE WHEN event_id % 4 = 0 OR event_id % 8 = 1 THEN CAST(CAST(floor(event_id / 4) AS BIGINT) AS STRING) ELSE '' END, ';',
   CAST(CAST(ts AS DATE) AS STRING), ';', CASE WHEN event_id % 37 = 0 THEN ' ' WHEN event_id % 5 = 0 THEN concat('"', event_type, '; ""first""') ELSE event_type END,
   CASE WHEN event_id % 5 = 0 AND event_id % 37 <> 0 THEN '' ELSE concat(';', CASE WHEN event_id % 31 = 0 THEN '' ELSE concat('C', CAST(user_id % 40 AS STRING)) END, ';',
    replace(CAST(CASE WHEN event_type = 'purchase' THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END AS STRING), '.', ','), ';',
    replace(CAST(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS STRING), '.', ',')) END) AS value FROM {base}
 UNION ALL
 SELECT concat('S', CAST(user_id % 2 AS STRING)), event_id * 2 + 2, concat('second; line";', CASE WHEN event_id % 31 = 0 THEN '' ELSE concat('C', CAST(user_id % 40 AS STRING)) END, ';',
    replace(CAST(CASE WHEN event_type = 'purchase' THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END AS STRING), '.', ','), ';',
    replace(CAST(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS STRING), '.', ',')) FROM {base}
  WHERE event_id % 5 = 0 AND event_id % 37 <> 0
 UNION ALL
 SELECT DISTINCT concat('S', CAST(user_id % 2 AS STRING)), CAST(0 AS BIGINT), 'N. Reg.;Data Reg.;Causale;Conto;Dare;Avere' FROM {base}) l""")
SOURCES = [("S0", "F", 2), ("S1", "F", 1)]
FOCUS, THRESHOLD, DAYS = ["c7", "C11"], Decimal("300.00"), (date(2024, 1, 1), date(2024, 12, 31))


def sheet(lines: DataFrame) -> DataFrame:
    """Cells of both files as typed columns."""
    rows = D.delimited_journal_scan(lines, width=6)
    cell = lambda i: F.col("cells")[i]
    return rows.select(
        "source_id", F.col("line_number").alias("position"), cell(0).try_cast("bigint").alias("entry_number"), date_lenient(cell(1)).alias("registration_date"),
        cell(2).alias("description"), F.coalesce(cell(3), F.lit("")).alias("account"), amount_lenient(F.coalesce(cell(4), F.lit(""))).cast("decimal(18,2)").alias("debit"),
        amount_lenient(F.coalesce(cell(5), F.lit(""))).cast("decimal(18,2)").alias("credit"))


def chart(spark: SparkSession) -> DataFrame:
    return spark.range(38).select(F.concat(F.lit("C"), F.col("id")).alias("account"))


RUNS: dict[tuple[str, str], L.EntryJournal] = {}


def journal(spark: SparkSession, sf_dir: str) -> L.EntryJournal:
    """Both files as one staged journal, staged once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in RUNS:
        sources = constant_table(spark, "source_id string, engagement_id string, source_order int", SOURCES)
        lines = StoredTable(shared(spark, sf_dir, "file_lines"), "file-lines")  # as files are: scanned by each step, not made anew
        cells = StoredTable(sheet(lines.read()), "sheet")
        assembled = StoredTable(E.assemble_entries(cells.read()), "assembled")
        RUNS[key] = L.stage_journal(*L.entries_of_sheets(assembled.read(), sources), (assembled,))
        cells.release()
        lines.release()
    return RUNS[key]


def sample(run: L.EntryJournal) -> DataFrame:
    return S.combined_sample(run.entries, run.rows, threshold=THRESHOLD, focus_accounts=FOCUS, include_round_amounts=True, random_count=25, seed=42,
                             date_from=DAYS[0], date_to=DAYS[1])


def file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read from the files, with their totals."""
    return journal(spark, sf_dir).entries.select("engagement_id", "entry_id", "entry_number", "registration_date", "load_order", "total_debit", "total_credit", "line_count")


def file_to_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the run over both files: sample, validations, anomalies, counts."""
    run = journal(spark, sf_dir)
    drawn = sample(run)
    checked = E.validate_entries(run.entries, run.rows, chart(spark)).join(drawn.select(*E.ENTRY_KEY), E.ENTRY_KEY, "left_semi")
    return P.run_status(P.severity_counts(checked, A.all_anomalies(run, drawn, chart(spark))))


_ORDER = "CASE source_id WHEN 'S0' THEN 2 ELSE 1 END * 1000000000000"
_ENTRY = "'F' AS engagement_id, concat(source_id, ':', entry_start * 2 - 1) AS entry_id, entry_number"
_VIEWS = {
    "entry_view": f"""SELECT {_ENTRY}, registration_date, CASE WHEN (entry_start - 1) % 37 = 0 THEN '' ELSE description END AS description,
 {_ORDER} + entry_start * 2 - 1 AS load_order FROM assembled WHERE position = entry_start""",
    "line_view": f"SELECT {_ENTRY}, position * 2 - 1 AS position, account, debit, credit FROM assembled WHERE entry_start IS NOT NULL AND account <> ''",
    "chart": "SELECT concat('C', range) AS account FROM range(38)",
}


def _oracle(sql: str, *views: str) -> str:
    """SQL of the entry tests over these files' views and parameters."""
    text = with_views(sql, "assembled", *views, instead=_VIEWS)
    for old, new in (("amount >= 400000", "amount >= 300"), ("('a7', 'a11')", "('c7', 'c11')"), ("DATE '1996-01-01' AND DATE '1999-12-31'", "DATE '2024-01-01' AND DATE '2024-12-31'")):
        text = text.replace(old, new)
    return text


QUERIES["E00_file_entries"] = file_entries
ORACLE["E00_file_entries"] = _oracle("SELECT engagement_id, entry_id, entry_number, registration_date, load_order, total_debit, total_credit, line_count FROM totalled", "totalled")
QUERIES["E00_file_to_status"] = file_to_status
ORACLE["E00_file_to_status"] = _oracle("SELECT * FROM status", "status")
