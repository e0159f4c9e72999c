"""Queries over statements, balances, tax slots, books and lineage (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.operators import reconciliation as B
from tallywright.plans import document_queries as Q
from tallywright.plans.ingest_queries import balance_sheet
from tallywright.plans.views import define, define_shared, italian_amount, shared, table, with_views
from tallywright.sources.delimited import trial_balance_scan

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, build, sql: str | None, *views: str) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE[name] = with_views(sql, *views) if views else sql


_CODES = ["E.1", "E.1", "E.1", "E.2", "E.3", "E.4", "G.2", "D.3", "G.1", "B.4", "D.1", "B.4", "B.1", "F.2", "F.3", "C.1", "C.2", "C.3", "C.4",
          "F.1", "F.1", "F.1", "F.1", "A.1", "B.3", "E.5", "F.1", "A.2", "E.1", "D.2", "E.2"]
define_shared("item_files", "documents", Q.with_views("SELECT *, " + Q._cycle(_CODES, "load_order") + " AS item_id FROM document_files", "document_files")
              .replace("FROM documents", "FROM {base}"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "item_files")


_BANK_NAMES = ["INTESA SANPAOLO", "Unicredit Roma", "BANCO BPM", "BPER BANCA", "MEDIOBANCA", "CASSA RURALE"]
_AMT = italian_amount("(user_id * 1000 + event_id)")
define_shared("dump_lines", "events", f"""
SELECT concat('E', CAST(CAST(floor(event_id / 8) AS BIGINT) % 3 AS STRING)) AS source_id, event_id + 1 AS line_number, CASE event_id % 8
 WHEN 0 THEN CASE WHEN event_id % 72 = 0 THEN 'XX' ELSE CASE WHEN event_id % 16 = 0 THEN 'BU01' ELSE 'sa22' END END
 WHEN 1 THEN {Q._cycle(_BANK_NAMES, 'CAST(floor(event_id / 8) AS BIGINT)')} WHEN 2 THEN CASE WHEN event_id % 5 = 0 THEN 'USD' ELSE 'EUR' END
 WHEN 3 THEN '30/06/2026' WHEN 4 THEN CASE WHEN event_id % 3 = 0 THEN {_AMT} ELSE 'n.d.' END WHEN 5 THEN CASE WHEN event_id % 7 = 0 THEN '-' ELSE {_AMT} END
 WHEN 6 THEN '0,00' ELSE ' ' END AS value FROM {{base}}""")
define("records", r"""
SELECT source_id, line_number, bank, currency, record_date, received, booked, difference FROM (
 SELECT source_id, line_number, v, lead(v, 1) OVER w AS bank, lead(v, 2) OVER w AS currency, lead(v, 3) OVER w AS record_date,
  TRY_CAST(replace(replace(lead(v, 4) OVER w, '.', ''), ',', '.') AS DECIMAL(18,2)) AS received,
  TRY_CAST(replace(replace(lead(v, 5) OVER w, '.', ''), ',', '.') AS DECIMAL(18,2)) AS booked,
  TRY_CAST(replace(replace(lead(v, 6) OVER w, '.', ''), ',', '.') AS DECIMAL(18,2)) AS difference, lead(v, 6) OVER w AS last
 FROM (SELECT source_id, line_number, trim(value) AS v FROM dump_lines WHERE trim(value) <> '') t WINDOW w AS (PARTITION BY source_id ORDER BY line_number)) u
WHERE regexp_matches(v, '(?i)^(BU|SA)[0-9]{2}$') AND regexp_matches(currency, '^[A-Z]{3}$') AND last IS NOT NULL AND (received IS NOT NULL OR booked IS NOT NULL)""", "dump_lines")
_add("B01_balance_records", lambda s, d: B.balance_records(shared(s, d, "dump_lines")), "SELECT * FROM records", "records")

define("statements", r"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY engagement_id ORDER BY points DESC, load_order) AS row_no FROM (
 SELECT *, row_number() OVER (PARTITION BY engagement_id, bank_key ORDER BY points DESC, load_order) AS best FROM (
  SELECT f.*, {key} AS bank_key, CASE WHEN regexp_matches(n, CASE m WHEN 6 THEN 'giu|giugno|jun|30[\s._-]?0?6|06[\s._-]30|06[\s._-]31'
    WHEN 9 THEN 'set|settembre|30[\s._-]?0?9|09[\s._-]30|09[\s._-]31' ELSE 'dic|dicembre|30[\s._-]?0?12|12[\s._-]30|12[\s._-]31' END) THEN 12 ELSE 0 END
   + CASE WHEN regexp_matches(n, '01[\s._-]jul|01[\s._-]lug|luglio|july') THEN -20 ELSE 0 END
   + CASE WHEN m = 6 AND regexp_matches(n, 'aprile|maggio|apr-|may-|apr26|mag26') THEN -8 ELSE 0 END
   + CASE WHEN contains(n, 'scalar') THEN -4 ELSE 0 END + CASE WHEN regexp_matches(n, 'ecommerce|e commerce|e-commerce') THEN 1 ELSE 0 END AS points
  FROM (SELECT *, lower(name) AS n, CASE load_order % 3 WHEN 0 THEN 6 WHEN 1 THEN 9 ELSE 12 END AS m FROM item_files WHERE item_id = 'F.1') f) a
 WHERE points >= 0) b WHERE best = 1) c""".replace("{key}", f"""coalesce(list_filter({Q._ALIASES}, lambda a: contains(lower(name), a))[1] || ':' ||
 coalesce(nullif(regexp_extract(lower(name), 'cc[_\\s-]*([0-9]+)', 1), ''), CASE WHEN contains(lower(name), 'usd') THEN 'usd'
  WHEN regexp_matches(lower(name), 'ecomm|e comm|e-comm') THEN 'ecom' ELSE 'cc' END), lower(name))"""), "item_files")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pick_statements(files(spark, sf_dir))


_add("B02_pick_statements", lambda s, d: statements(s, d).select("engagement_id", "bank_key", "load_order", "name", "points", "row_no"),
     "SELECT engagement_id, bank_key, load_order, name, points, CAST(row_no AS INT) AS row_no FROM statements", "statements")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.balance_records(shared(spark, sf_dir, "dump_lines"))
    return found.withColumnRenamed("source_id", "engagement_id").withColumnRenamed("line_number", "load_order")


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements of the population against the booked balances of their engagement."""
    return B.reconcile_banks(files(spark, sf_dir).filter("item_id = 'F.1'"), records(spark, sf_dir))


_BALANCE_SQL = Q.ORACLE["F11_statement_balance"].split("SELECT load_order, ", 1)[1].rsplit(" AS balance", 1)[0]
_ACCOUNT_SQL = Q.ORACLE["F14_statement_account"].split("SELECT load_order, ", 1)[1].rsplit(" AS account", 1)[0]
define("statement_rows", f"""
SELECT engagement_id, load_order, name, {Q._BANK_LABEL} AS bank, {Q._ALIAS_KEY} AS alias, CASE WHEN contains(lower(concat(name, ' ', text)), 'usd') THEN 'USD' ELSE 'cc' END AS currency,
 {_ACCOUNT_SQL} AS account, {_BALANCE_SQL} AS statement_balance FROM item_files WHERE item_id = 'F.1'""", "item_files")
define("reconciled", """
SELECT s.engagement_id, s.load_order, name, s.bank, s.currency, account, statement_balance, (SELECT arg_min(r.booked, r.line_number) FROM records r
 WHERE r.source_id = s.engagement_id AND contains(lower(r.bank), s.alias) AND (r.currency = 'USD') = (s.currency = 'USD') AND r.booked IS NOT NULL) AS booked
FROM statement_rows s""", "statement_rows", "records")
_add("B03_reconcile_banks", reconciled, "SELECT * FROM reconciled", "reconciled")


def bank_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as ledger accounts of three engagements, some named like banks."""
    labels = F.array(*[F.lit(x) for x in ("Mediobanca c/c", "CONTO corrente", "Cassa", "bper anticipi", "Clienti", "Banco di Napoli", "Unicredit")])
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("E"), key % 3).alias("engagement_id"), key.alias("load_order"),
        F.element_at(labels, (key % 7 + 1).cast("int")).alias("name"),
        F.when(key % 5 != 0, F.col("c_acctbal").cast("decimal(18,2)")).alias("amount"))


define("bank_accounts", """
SELECT concat('E', CAST(c_custkey % 3 AS VARCHAR)) AS engagement_id, c_custkey AS load_order,
 ['Mediobanca c/c', 'CONTO corrente', 'Cassa', 'bper anticipi', 'Clienti', 'Banco di Napoli', 'Unicredit'][c_custkey % 7 + 1] AS name,
 CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS amount FROM customer""")


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ledger_fallback(reconciled(spark, sf_dir), bank_accounts(spark, sf_dir))


define("complete", """
SELECT * REPLACE (coalesce(booked, amount) AS booked), CASE WHEN booked IS NOT NULL THEN 'dump' WHEN amount IS NOT NULL THEN 'ledger' END AS booked_source FROM (
 SELECT r.*, (SELECT arg_min(a.amount, a.load_order) FROM bank_accounts a WHERE a.engagement_id = r.engagement_id AND a.amount IS NOT NULL
  AND contains(lower(a.name), lower(split_part(r.bank, ' ', 1)))) AS amount FROM reconciled r) t""", "reconciled", "bank_accounts")
_add("B04_ledger_fallback", complete, "SELECT * EXCLUDE (amount) FROM complete", "complete")
_add("B05_bank_check", lambda s, d: B.bank_check(complete(s, d)), """
SELECT * EXCLUDE (amount), booked - statement_balance AS delta, CASE WHEN abs(booked - statement_balance) >= 0.005 THEN
 concat(bank, ': check bancario ≠ 0 (Δ ', CAST(booked - statement_balance AS DECIMAL(18,2)), ')') END AS warning FROM complete""", "complete")
_add("B06_bank_totals", lambda s, d: B.bank_totals(B.bank_check(complete(s, d))), """
SELECT engagement_id, count(*) AS bank_rows, sum(booked) AS total_booked, sum(statement_balance) AS total_statement_balance,
 sum(booked - statement_balance) AS total_delta FROM complete GROUP BY ROLLUP (engagement_id)""", "complete")
_add("B07_balance_variation", lambda s, d: B.balance_variation(trial_balance_scan(balance_sheet(s, d))), """
SELECT *, amount - prior AS variation, CASE WHEN prior <> 0 THEN CAST(amount / prior - 1 AS DECIMAL(18,6)) END AS variation_share FROM trial_balance""", "trial_balance")

# --- tax, funds, books, minutes ------------------------------------------------------------------

_PAY = Q.ORACLE["F13_payment_date"].split("SELECT load_order, ", 1)[1].rsplit(" AS payment_day", 1)[0]
_TAX = Q.ORACLE["F10_tax_payment_amount"].split("SELECT load_order, ", 1)[1].rsplit(" AS amount", 1)[0]
_TOKEN_DATE = """CAST(CASE WHEN regexp_matches(translate({x}, '-.', '//'), '/[0-9]{4}$') THEN try_strptime(translate({x}, '-.', '//'), '%d/%m/%Y')
 WHEN regexp_matches(translate({x}, '-.', '//'), '/[0-9]{2}$') THEN try_strptime(translate({x}, '-.', '//'), '%d/%m/%y') END AS DATE)"""
define("receipts", f"""
SELECT engagement_id, load_order, name, k, m0, {Q._MONTH} AS name_month, lower(concat(name, ' ', text)) AS blob,
 list_transform(regexp_extract_all(text, '{Q._DATES}', 1), lambda x: month({_TOKEN_DATE.replace('{x}', 'x')})) AS date_months,
 coalesce({_TOKEN_DATE.replace('{x}', '(' + _PAY + ')')}, CAST(CASE WHEN regexp_matches(name, '\\b[0-9]{{6}}\\b') THEN try_strptime(regexp_extract(name, '\\b([0-9]{{6}})\\b', 1), '%d%m%y') END AS DATE)) AS paid_on,
 {_TAX} AS amount, nullif(regexp_extract(text, '\\b([0-9]{{15,20}})\\b', 1), '') AS protocol FROM (
 SELECT *, row_number() OVER (PARTITION BY engagement_id ORDER BY load_order) AS k, CASE load_order % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END AS m0
 FROM item_files WHERE item_id = 'E.1' AND NOT contains(lower(name), 'bollo')) t""", "item_files")
define("tax_slots", """
SELECT engagement_id, slot, CASE m0 WHEN 4 THEN 2026 WHEN 7 THEN 2025 ELSE 2024 END AS year, m0 + slot - 1 AS month, count(*) AS receipts,
 arg_max(paid_on, load_order) FILTER (WHERE paid_on IS NOT NULL) AS paid_on, arg_max(amount, load_order) FILTER (WHERE amount IS NOT NULL) AS amount,
 arg_max(protocol, load_order) FILTER (WHERE protocol IS NOT NULL) AS protocol FROM (
 SELECT *, coalesce(list_filter([1, 2, 3], lambda i: coalesce(name_month = m0 + i - 1, false) OR contains(blob,
  ['gennaio','febbraio','marzo','aprile','maggio','giugno','luglio','agosto','settembre','ottobre','novembre','dicembre'][m0 + i - 1])
  OR coalesce(list_contains(date_months, m0 + i - 1), false))[1], CASE WHEN k <= 3 THEN k END) AS slot FROM receipts) t WHERE slot IS NOT NULL GROUP BY ALL""", "receipts")
_add("B08_tax_payment_slots", lambda s, d: B.tax_payment_slots(files(s, d)),
     "SELECT engagement_id, slot, year, CAST(month AS INT) AS month, receipts, paid_on, amount, protocol FROM tax_slots", "tax_slots")
_add("B09_fund_quarter_slots", lambda s, d: B.fund_quarter_slots(files(s, d)), f"""
SELECT engagement_id, load_order, row_label, CASE WHEN q = 1 THEN '✓' END AS q1, CASE WHEN q = 2 THEN '✓' END AS q2, CASE WHEN q = 3 THEN '✓' END AS q3, CASE WHEN q = 4 THEN '✓' END AS q4 FROM (
 SELECT engagement_id, load_order, regexp_replace(name, '\\.[^.]*$', '') AS row_label,
  coalesce({Q._QUARTER.format(n="lower(concat(name, ' ', excerpt, ' ', text))")}, CASE load_order % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END) AS q FROM item_files WHERE item_id = 'E.2'
 UNION ALL SELECT engagement_id, min(load_order), CASE item_id WHEN 'E.3' THEN 'LIPE' ELSE 'IVA annuale' END, CASE min(load_order) % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END
 FROM item_files WHERE item_id IN ('E.3', 'E.4') GROUP BY engagement_id, item_id) t""", "item_files")


def closing_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books; those of document kind 2 end with a closing page."""
    return files(spark, sf_dir).filter("item_id IN ('D.3', 'G.1', 'B.4', 'D.1')")


define("ranked", """
SELECT *, CASE WHEN item_id = 'B.4' AND NOT contains(lower(name), 'mastrini') THEN 1 WHEN item_id = 'D.1' AND NOT contains(lower(rel_path), 'libri fiscali') THEN 1 ELSE 0 END AS pref,
 CASE WHEN item_id IN ('B.4', 'D.1') THEN name ELSE '' END AS by_name FROM item_files
WHERE item_id IN ('D.3', 'G.1', 'B.4', 'D.1')""", "item_files")
_add("B10_books_update", lambda s, d: B.books_update(closing_books(s, d)), """
SELECT b.engagement_id, b.item_id, array_to_string(names, ', ') AS names,
 CASE WHEN b.item_id IN ('B.4', 'D.1') THEN CAST(CASE WHEN length(closing_date) = 8 THEN try_strptime(closing_date, '%d/%m/%y') ELSE try_strptime(translate(closing_date, '.-', '//'), '%d/%m/%Y') END AS DATE) END AS last_date,
 CASE WHEN b.item_id IN ('B.4', 'D.1') THEN page END AS last_page,
 CASE WHEN b.item_id IN ('B.4', 'D.1') THEN nullif(description, '') END AS description,
 CASE WHEN b.item_id IN ('B.4', 'D.1') THEN 'ultima pagina (chiusura stampa)' ELSE concat(n, ' file in cartella') END AS note FROM (
 SELECT engagement_id, item_id, count(*) AS n, (array_agg(load_order ORDER BY pref, by_name, load_order))[1] AS first_doc FROM ranked GROUP BY 1, 2) b JOIN (
 SELECT engagement_id, item_id, array_agg(name ORDER BY o) AS names FROM (
  SELECT engagement_id, item_id, name, min(struct_pack(pref, by_name, load_order)) AS o FROM ranked GROUP BY 1, 2, 3) x GROUP BY 1, 2) l USING (engagement_id, item_id) JOIN closings ON closings.load_order = first_doc""", "ranked", "closings")
_add("B11_minutes_register", lambda s, d: B.minutes_register(files(s, d)), f"""
SELECT engagement_id, item_id, name, CASE WHEN item_id <> 'C.3' THEN CASE WHEN regexp_matches(name, '20[0-9]{{6}}') THEN CAST(strptime(regexp_extract(name, '20[0-9]{{6}}'), '%Y%m%d') AS DATE)
  ELSE {_TOKEN_DATE.replace('{x}', f"(regexp_extract_all(text, '{Q._DATES}', 1)[-1])")} END END AS meeting_date,
 CASE WHEN item_id <> 'C.3' THEN TRY_CAST(nullif(regexp_extract(concat(name, ' ', text), '(?i)pag(?:ina|\\.)?\\s*([0-9]+)', 1), '') AS INT) END AS page FROM (
 SELECT *, row_number() OVER (PARTITION BY engagement_id, item_id ORDER BY load_order) AS rn FROM (
  SELECT engagement_id, load_order, name, text, item_id FROM item_files WHERE item_id IN ('C.1', 'C.2', 'C.3', 'C.4')
  UNION ALL SELECT engagement_id, load_order, name, text, 'C.3' FROM item_files WHERE item_id = 'C.1' AND contains(lower(name), 'collegio')
   AND engagement_id NOT IN (SELECT engagement_id FROM item_files WHERE item_id = 'C.3')) a) b WHERE rn = 1""", "item_files")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = complete(spark, sf_dir).withColumns(
        {"source_path": F.concat(F.lit("F_Banche/"), "name"), "source_name": F.col("name"), "method": F.lit("txt"),
         "confidence": F.lit(0.85).cast("decimal(4,2)"), "excerpt": F.concat(F.lit("saldo="), F.coalesce(F.col("statement_balance").cast("string"), F.lit("")) ),
         "human": F.lit(False)})
    return B.provenance(rows, {"bank": "F.1", "account": "F.1", "statement_balance": "F.1", "booked": "F.2"}, ["engagement_id", "load_order"])


_add("B12_provenance", lineage, " UNION ALL ".join(
    f"SELECT engagement_id, load_order, '{field}' AS field, '{item}' AS item_id, CAST({field} AS VARCHAR) AS value, concat('F_Banche/', name) AS source_path, name AS source_name, "
    f"'txt' AS method, 0.85 AS confidence, concat('saldo=', statement_balance) AS excerpt, false AS human FROM complete WHERE {field} IS NOT NULL"
    for field, item in (("bank", "F.1"), ("account", "F.1"), ("statement_balance", "F.1"), ("booked", "F.2"))), "complete")
