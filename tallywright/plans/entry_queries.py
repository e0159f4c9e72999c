"""Queries over entries and lines derived from orders and their line items (E)."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallywright.constants import FIRST_DIGIT_SHARES
from tallywright.functions.tables import held
from tallywright.operators import anomalies as A, entries as E, entry_layout as L, reporting as P, sampling as S
from tallywright.plans.views import define, table, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, build, sql: str | None, *views: str) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE[name] = with_views(sql, *views) if views else sql


# --- views ---------------------------------------------------------------------------------------

COPY_OFFSET = 10_000_000

define("item_lines", """
SELECT l_orderkey AS entry_number, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS position, concat('A', CAST(l_partkey % 200 AS VARCHAR)) AS account,
 CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS debit,
 CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS DECIMAL(18,2)) AS credit FROM lineitem""")
define("line_view", """
SELECT concat('E', CAST(entry_number % 3 AS VARCHAR)) AS engagement_id, CAST(entry_number AS VARCHAR) AS entry_id,
 entry_number, position, account, debit, credit FROM (
 SELECT * FROM item_lines
 UNION ALL SELECT entry_number, 1000000000000, 'BALANCE', greatest(0, sum(credit) - sum(debit)), greatest(0, sum(debit) - sum(credit))
 FROM item_lines WHERE entry_number % 10 <> 0 GROUP BY entry_number) t
UNION ALL
SELECT concat('E', CAST(entry_number % 3 AS VARCHAR)), concat('D', CAST(entry_number AS VARCHAR)), entry_number + 10000000,
 position, account, debit, credit FROM item_lines WHERE entry_number % 500 = 0""", "item_lines")
define("entry_view", """
SELECT concat('E', CAST(k % 3 AS VARCHAR)) AS engagement_id, CAST(k AS VARCHAR) AS entry_id, k AS entry_number, d AS registration_date,
 description, k AS load_order FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d,
  CASE WHEN o_orderkey % 40 = 0 THEN '' ELSE o_orderpriority END AS description FROM orders) o
WHERE k IN (SELECT l_orderkey FROM lineitem) OR k % 701 = 0
UNION ALL
SELECT concat('E', CAST(o_orderkey % 3 AS VARCHAR)), concat('D', CAST(o_orderkey AS VARCHAR)), o_orderkey + 10000000,
 CAST(o_orderdate AS DATE), o_orderpriority, o_orderkey + 10000000 FROM orders
WHERE o_orderkey % 500 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
define("totalled", """
SELECT *, total_debit - total_credit AS difference, total_debit = total_credit AS balanced,
 greatest(total_debit, total_credit) AS amount FROM (
 SELECT e.*, coalesce(sum(debit), 0) AS total_debit, coalesce(sum(credit), 0) AS total_credit, count(l.entry_id) AS line_count
 FROM entry_view e LEFT JOIN line_view l ON l.engagement_id = e.engagement_id AND l.entry_id = e.entry_id
 GROUP BY ALL) t""", "entry_view", "line_view")
define("chart", "SELECT DISTINCT concat('A', CAST(p_partkey % 190 AS VARCHAR)) AS account FROM part")


def _keyed(number: Column, prefix: Column) -> list[Column]:
    return [F.concat(F.lit("E"), (number % 3).cast("string")).alias("engagement_id"), F.concat(prefix, number.cast("string")).alias("entry_id")]


def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as journal lines: nine of ten entries get a balancing line, every 500th a copy. The table is read once."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    returned = F.col("l_returnflag") == "R"
    number = F.col("entry_number")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entry_number"),
        (F.col("l_linenumber").cast("bigint") * 10**10 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("position"),
        F.concat(F.lit("A"), F.col("l_partkey") % 200).alias("account"),
        F.when(returned, zero).otherwise(price).alias("debit"),
        F.when(returned, price).otherwise(zero).alias("credit"),
    )
    entry = W.partitionBy("entry_number")  # an order has few items
    ranked = entry.orderBy("position")  # one order for both, so that rows are sorted once
    open_amount = F.sum(F.col("debit") - F.col("credit")).over(ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = F.row_number().over(ranked) == 1
    own = F.struct(F.lit("").alias("prefix"), "position", "account", "debit", "credit")
    balance = F.struct(
        F.lit("").alias("prefix"), F.lit(10**12).alias("position"), F.lit("BALANCE").alias("account"),
        F.greatest(zero, -F.col("_open")).cast("decimal(18,2)").alias("debit"), F.greatest(zero, F.col("_open")).cast("decimal(18,2)").alias("credit"))
    copy = F.struct(F.lit("D").alias("prefix"), "position", "account", "debit", "credit")
    each = F.array_compact(F.array(own, F.when(F.col("_begins") & (number % 10 != 0), balance), F.when(number % 500 == 0, copy)))
    rows = items.withColumns({"_open": open_amount, "_begins": first}).select("entry_number", F.explode(each).alias("x"))
    return rows.select(
        *_keyed(number, F.col("x.prefix")), (number + F.when(F.col("x.prefix") == "D", COPY_OFFSET).otherwise(0)).alias("entry_number"),
        "x.position", "x.account", "x.debit", "x.credit")


def journal_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries: those with items, a few without, and a copy of every 500th. Each table is read once."""
    key = F.col("o_orderkey")
    ordered = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("registration_date"), "o_orderpriority")
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_used", F.lit(True))
    marked = ordered.join(used, "o_orderkey", "left").withColumn("_used", F.coalesce("_used", F.lit(False))).filter(F.col("_used") | (key % 701 == 0))
    prefixes = F.when(F.col("_used") & (key % 500 == 0), F.array(F.lit(""), F.lit("D"))).otherwise(F.array(F.lit("")))
    rows = marked.withColumn("_prefix", F.explode(prefixes))
    copied = F.col("_prefix") == "D"
    shift = F.when(copied, COPY_OFFSET).otherwise(0)
    description = F.when((key % 40 == 0) & ~copied, "").otherwise(F.col("o_orderpriority")).alias("description")
    return rows.select(
        *_keyed(key, F.col("_prefix")), (key + shift).alias("entry_number"), "registration_date", description, (key + shift).alias("load_order"))


STAGED: dict[tuple[str, str], L.EntryJournal] = {}


def staged(spark: SparkSession, sf_dir: str) -> L.EntryJournal:
    """The journal as all queries below read it: staged by the first of them, for the session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in STAGED:
        STAGED[key] = L.stage_journal(journal_entries(spark, sf_dir), journal_lines(spark, sf_dir))
    return STAGED[key]


def restaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal staged anew; its lines."""
    old = STAGED.pop((spark.sparkContext.applicationId, sf_dir), None)
    if old:
        old.release()
    return staged(spark, sf_dir).lines


def totalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir).entries


def chart_of_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("A"), F.col("p_partkey") % 190).alias("account")).distinct()


# --- assembling ----------------------------------------------------------------------------------

SHEET_SQL = """
SELECT concat('S', CAST(user_id % 2 AS VARCHAR)) AS source_id, event_id + 1 AS position,
 CASE WHEN event_id % 4 = 0 OR event_id % 8 = 1 THEN CAST(floor(event_id / 4) AS BIGINT) END AS entry_number,
 CASE WHEN event_id % 31 = 0 THEN '' ELSE concat('C', CAST(user_id % 40 AS VARCHAR)) END AS account,
 CAST(ts AS DATE) AS registration_date, event_type AS description,
 CAST(CASE WHEN event_type = 'purchase' THEN 0 ELSE value END AS DECIMAL(18,2)) AS debit,
 CAST(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS DECIMAL(18,2)) AS credit FROM events"""


def journal_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a journal file where the entry number stands on some lines only."""
    event, value = F.col("event_id"), F.col("value").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    credited = F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), F.col("user_id") % 2).alias("source_id"),
        (event + 1).alias("position"),
        F.when((event % 4 == 0) | (event % 8 == 1), F.floor(event / 4)).alias("entry_number"),
        F.when(event % 31 == 0, "").otherwise(F.concat(F.lit("C"), F.col("user_id") % 40)).alias("account"),
        F.col("ts").cast("date").alias("registration_date"),
        F.col("event_type").alias("description"),
        F.when(credited, zero).otherwise(value).alias("debit"),
        F.when(credited, value).otherwise(zero).alias("credit"),
    )


define("assembled", f"""
SELECT source_id, position, account, registration_date, description, debit, credit, current AS entry_number,
 max(CASE WHEN starts THEN position END) OVER (PARTITION BY source_id ORDER BY position) AS entry_start FROM (
 SELECT *, entry_number IS NOT NULL AND (before IS NULL OR before <> entry_number) AS starts,
  coalesce(entry_number, before) AS current FROM (
  SELECT *, last_value(entry_number IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY position
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({SHEET_SQL}) a) b) c""")


def assembled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entries_and_lines(E.assemble_entries(journal_sheet(spark, sf_dir)))[1]


def assembled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entries_and_lines(E.assemble_entries(journal_sheet(spark, sf_dir)))[0]


_add("E01_assemble_entries", assembled_headers, """
SELECT source_id, entry_start, entry_number, registration_date, description FROM assembled WHERE position = entry_start""", "assembled")
_add("E01_assembled_lines", assembled_lines, """
SELECT source_id, entry_start, entry_number, position, account, debit, credit FROM assembled
WHERE entry_start IS NOT NULL AND account <> ''""", "assembled")

# --- validations ---------------------------------------------------------------------------------

_add("E02_entry_totals", lambda s, d: L.totals_of_lines(staged(s, d)), """
SELECT engagement_id, entry_id, sum(debit) AS total_debit, sum(credit) AS total_credit, count(*) AS line_count,
 sum(debit) - sum(credit) AS difference, sum(debit) = sum(credit) AS balanced, greatest(sum(debit), sum(credit)) AS amount
FROM line_view GROUP BY ALL""", "line_view")

_HEAD = "engagement_id, '{kind}' AS anomaly_type, '{severity}' AS severity, entry_id, entry_number"


def _flat(df: DataFrame, *details: str) -> DataFrame:
    return df.select(*[c for c in E.ANOMALY if c != "details"], *[F.col("details")[k].alias(k) for k in details])


def _head(kind: str, severity: str) -> str:
    return _HEAD.format(kind=kind, severity=severity)


define("a_unbalanced", f"""
SELECT {_head('unbalanced', 'critical')}, concat('Registrazione n. ', entry_number, ' sbilanciata: Dare=', total_debit,
 ', Avere=', total_credit, ', Differenza=', abs(difference)) AS description, CAST(difference AS VARCHAR) AS difference
FROM totalled WHERE difference <> 0""", "totalled")
_add("E03_unbalanced_entries", lambda s, d: _flat(E.unbalanced_entries(totalled(s, d)), "difference"),
     "SELECT * FROM a_unbalanced", "a_unbalanced")


_add("E04_date_regression", lambda s, d: _flat(E.date_regression(journal_entries(s, d)), "previous_date"), f"""
SELECT {_head('invalid_date', 'warning')}, concat('Registrazione n. ', entry_number, ' con data anteriore alla precedente: ',
 registration_date, ' < ', previous_date) AS description, CAST(previous_date AS VARCHAR) AS previous_date FROM (
 SELECT *, lag(registration_date) OVER (PARTITION BY engagement_id ORDER BY load_order) AS previous_date FROM entry_view) t
WHERE registration_date < previous_date""", "entry_view")
define("a_account", f"""
SELECT {_head('missing_account', 'warning')}, concat('Registrazione n. ', entry_number, ': codice conto ''', account,
 ''' non trovato nel piano dei conti') AS description, account AS account_code
FROM line_view WHERE account NOT IN (SELECT account FROM chart)""", "line_view", "chart")
_add("E05_unknown_accounts",
     lambda s, d: _flat(E.unknown_accounts(staged(s, d).lines, chart_of_accounts(s, d)), "account_code"),
     "SELECT * FROM a_account", "a_account")
define("a_description", f"""
SELECT {_head('missing_description', 'info')}, concat('Registrazione n. ', entry_number, ' senza causale/descrizione') AS description
FROM entry_view WHERE trim(description) = ''""", "entry_view")
_add("E06_missing_description", lambda s, d: _flat(E.missing_description(totalled(s, d))),
     "SELECT * FROM a_description", "a_description")
define("a_lines", f"""
SELECT {_head('other', 'warning')}, concat('Registrazione n. ', entry_number, ' con meno di 2 righe (trovate: ', line_count, ')') AS description
FROM totalled WHERE line_count < 2""", "totalled")
_add("E07_too_few_lines", lambda s, d: _flat(E.too_few_lines(totalled(s, d))), "SELECT * FROM a_lines", "a_lines")
define("a_weekend", f"""
SELECT {_head('weekend_entry', 'info')}, concat('Registrazione n. ', entry_number, ' in ',
 CASE WHEN isodow(registration_date) = 6 THEN 'Sabato' ELSE 'Domenica' END, ' (', registration_date, ')') AS description
FROM entry_view WHERE isodow(registration_date) >= 6""", "entry_view")
_add("E08_weekend_entries", lambda s, d: _flat(E.weekend_entries(totalled(s, d))), "SELECT * FROM a_weekend", "a_weekend")
define("a_gap", f"""
SELECT {_head('sequence_gap', 'warning')}, concat('Buco nella numerazione: da ', p, ' a ', entry_number, ', mancano ',
 entry_number - p - 1, ' registrazioni') AS description,
 array_to_string(range(p + 1, least(entry_number, p + 11)), ',') AS missing_numbers FROM (
 SELECT *, lag(entry_number) OVER (PARTITION BY engagement_id ORDER BY entry_number, load_order) AS p FROM entry_view) t
WHERE entry_number - p > 1""", "entry_view")
_add("E09_entry_number_gaps", lambda s, d: _flat(E.entry_number_gaps(totalled(s, d), listed=10), "missing_numbers"),
     "SELECT * FROM a_gap", "a_gap")
define("a_duplicate", f"""
SELECT {_head('duplicate', 'warning')}, concat('Possibile duplicato della registrazione n. ', o, ': stessa data, conto e importo') AS description,
 concat_ws('|', registration_date, first_account, amount) AS signature FROM (
 SELECT *, row_number() OVER w AS rn, first_value(entry_number) OVER w AS o FROM (
  SELECT e.*, l.first_account, l.amount FROM entry_view e JOIN (
   SELECT engagement_id, entry_id, greatest(sum(debit), sum(credit)) AS amount,
    arg_min(account, position) AS first_account FROM line_view GROUP BY ALL) l
  ON l.engagement_id = e.engagement_id AND l.entry_id = e.entry_id) x
 WINDOW w AS (PARTITION BY engagement_id, registration_date, first_account, amount ORDER BY load_order)) t
WHERE rn > 1""", "entry_view", "line_view")


def unbalanced_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.duplicate_entries(staged(spark, sf_dir).first_lines)


_add("E10_duplicate_entries", lambda s, d: _flat(unbalanced_copies(s, d), "signature"), "SELECT * FROM a_duplicate", "a_duplicate")


def _joined_checks(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in ("checks_passed", "checks_failed")})


def validations(spark: SparkSession, sf_dir: str, order: str = "registration_date") -> DataFrame:
    journal = staged(spark, sf_dir)
    return E.validate_entries(journal.entries, journal.rows, chart_of_accounts(spark, sf_dir), order)


def _validation_sql(order: str) -> str:
    back = "registration_date < prev_date" if order == "load_order" else "false"
    sort = "load_order" if order == "load_order" else "registration_date, load_order"
    return f"""
SELECT engagement_id, entry_id, entry_number,
 concat_ws(',', CASE WHEN difference = 0 THEN 'bilanciamento' END, CASE WHEN prev_date IS NOT NULL AND NOT ({back}) THEN 'sequenza_date' END,
  CASE WHEN NOT outside THEN 'codici_conto' END, CASE WHEN NOT thin THEN 'completezza' END, 'weekend') AS checks_passed,
 concat_ws(',', CASE WHEN difference <> 0 THEN 'bilanciamento' END, CASE WHEN prev_date IS NOT NULL AND ({back}) THEN 'sequenza_date' END,
  CASE WHEN outside THEN 'codici_conto' END, CASE WHEN thin THEN 'completezza' END) AS checks_failed,
 difference = 0 AND NOT outside AND NOT thin AND NOT (prev_date IS NOT NULL AND ({back})) AS is_valid FROM (
 SELECT t.*, lag(registration_date) OVER (PARTITION BY engagement_id ORDER BY {sort}) AS prev_date,
  trim(description) = '' OR line_count < 2 AS thin,
  entry_id IN (SELECT entry_id FROM line_view WHERE account NOT IN (SELECT account FROM chart)) AS outside
 FROM totalled t) u"""


define("validated", _validation_sql("registration_date"), "totalled", "line_view", "chart")
_add("E11_validate_entries", lambda s, d: _joined_checks(validations(s, d)), "SELECT * FROM validated", "validated")
_add("E11_validate_in_load_order", lambda s, d: _joined_checks(validations(s, d, "load_order")),
     _validation_sql("load_order"), "totalled", "line_view", "chart")

# --- samples -------------------------------------------------------------------------------------

_SAMPLE = ["engagement_id", "entry_id", "entry_number", "amount"]
_SAMPLE_SQL = ", ".join(_SAMPLE)
THRESHOLD, FOCUS, SEED, DRAWS = Decimal("400000.00"), ["a7", "A11"], 42, 25


def round_totalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose amounts are cut to hundreds, so that round amounts occur."""
    return totalled(spark, sf_dir).withColumn("amount", F.floor(F.col("amount") / 100) * F.lit(100).cast("decimal(18,2)"))


_add("E12_sample_by_threshold", lambda s, d: S.sample_by_threshold(totalled(s, d), THRESHOLD).select(*_SAMPLE),
     f"SELECT {_SAMPLE_SQL} FROM totalled WHERE amount >= 400000", "totalled")
_add("E13_sample_by_accounts",
     lambda s, d: S.sample_by_accounts(totalled(s, d), staged(s, d).rows, FOCUS).select(*_SAMPLE), f"""
SELECT {_SAMPLE_SQL} FROM totalled JOIN (SELECT DISTINCT engagement_id, entry_id FROM line_view WHERE lower(account) IN ('a7', 'a11')) f
USING (engagement_id, entry_id)""", "totalled", "line_view")
_add("E14_sample_unbalanced", lambda s, d: S.sample_unbalanced(totalled(s, d)).select(*_SAMPLE),
     f"SELECT {_SAMPLE_SQL} FROM totalled WHERE total_debit <> total_credit", "totalled")
_add("E15_sample_round_amounts", lambda s, d: S.sample_round_amounts(round_totalled(s, d)).select(*_SAMPLE), """
SELECT engagement_id, entry_id, entry_number, amount FROM (SELECT * REPLACE (CAST(floor(amount / 100) * 100 AS DECIMAL(38,2)) AS amount) FROM totalled) t
WHERE amount >= 1000 AND amount % 1000 = 0""", "totalled")
define("draws", "SELECT *, row_number() OVER (PARTITION BY engagement_id ORDER BY md5(concat('42:', entry_id)), entry_id) AS draw FROM totalled", "totalled")
_add("E16_sample_random", lambda s, d: S.sample_random(totalled(s, d), DRAWS, SEED).select(*_SAMPLE),
     f"SELECT {_SAMPLE_SQL} FROM draws WHERE draw <= 25", "draws")


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.combined_sample(
        totalled(spark, sf_dir), staged(spark, sf_dir).rows, threshold=THRESHOLD, focus_accounts=FOCUS,
        include_round_amounts=True, random_count=DRAWS, seed=SEED, date_from=date(1996, 1, 1), date_to=date(1999, 12, 31))


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sample as a table, for queries that read it several times."""
    return held(spark, "sample", sf_dir, lambda: combined(spark, sf_dir))


define("sampled", """
SELECT * FROM (SELECT * REPLACE (CASE WHEN sample_reason IS NULL AND row_number() OVER (PARTITION BY engagement_id, sample_reason IS NULL
  ORDER BY md5(concat('42:', entry_id)), entry_id) <= 25 THEN 'random' ELSE sample_reason END AS sample_reason) FROM (
 SELECT *, CASE WHEN amount >= 400000 THEN 'threshold'
  WHEN entry_id IN (SELECT entry_id FROM line_view WHERE lower(account) IN ('a7', 'a11')) THEN 'focus_account'
  WHEN total_debit <> total_credit THEN 'unbalanced'
  WHEN amount >= 1000 AND amount % 1000 = 0 THEN 'round_amount' END AS sample_reason
 FROM totalled WHERE registration_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') t) u WHERE sample_reason IS NOT NULL
""", "totalled", "line_view")
_add("E17_combined_sample", lambda s, d: combined(s, d).select(*_SAMPLE, "sample_reason"),
     f"SELECT {_SAMPLE_SQL}, sample_reason FROM sampled", "sampled")
define("stats", """
SELECT engagement_id, total_entries, coalesce(n, 0) AS sample_size,
 CAST(coalesce(n, 0) * 100 / total_entries AS DECIMAL(9,4)) AS sample_percentage, coalesce(a, 0) AS total_amount_sampled
FROM (SELECT engagement_id, count(*) AS total_entries FROM entry_view GROUP BY 1) p
LEFT JOIN (SELECT engagement_id, count(*) AS n, sum(amount) AS a FROM sampled GROUP BY 1) s USING (engagement_id)""",
       "entry_view", "sampled")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_stats(drawn(spark, sf_dir), totalled(spark, sf_dir))


_add("E18_sample_stats", statistics, "SELECT * FROM stats", "stats")

# --- pattern tests -------------------------------------------------------------------------------

_SHARES = ", ".join(f"('{d}', CAST({share} AS DECIMAL(9,6)))" for d, share in FIRST_DIGIT_SHARES.items())
define("digits", f"""
SELECT engagement_id, sample_size, digit, digit_rows, expected, CAST(digit_rows / sample_size AS DECIMAL(9,6)) AS observed,
 CAST(abs(CAST(digit_rows / sample_size AS DECIMAL(9,6)) - expected) AS DECIMAL(9,6)) AS deviation FROM (
 SELECT engagement_id, digit, expected, count(*) FILTER (WHERE left(CAST(amount AS VARCHAR), 1) = digit) AS digit_rows,
  count(*) AS sample_size FROM totalled, (VALUES {_SHARES}) AS b(digit, expected) WHERE amount >= 1 GROUP BY ALL) t
WHERE sample_size >= 50""", "totalled")
_add("E19_benford_first_digit", lambda s, d: A.first_digit_distribution(totalled(s, d)), "SELECT * FROM digits", "digits")
define("a_benford", f"""
SELECT engagement_id, 'other' AS anomaly_type, 'warning' AS severity, '' AS entry_id, CAST(0 AS BIGINT) AS entry_number,
 concat('Distribuzione delle prime cifre devia dalla Legge di Benford: cifra ''', digit, ''' devia del ',
  CAST(deviation * 100 AS DECIMAL(9,1)), '% (osservato: ', CAST(observed * 100 AS DECIMAL(9,1)), '%, atteso: ',
  CAST(expected * 100 AS DECIMAL(9,1)), '%)') AS description FROM (
 SELECT *, row_number() OVER (PARTITION BY engagement_id ORDER BY deviation DESC, digit) AS rn FROM digits) t
WHERE rn = 1 AND deviation > {{limit}}""", "digits")
_add("E19_benford_anomaly", lambda s, d: _flat(A.benford_first_digit(totalled(s, d), "0.01")),
     "SELECT * FROM benford_low", "a_benford")
ORACLE["E19_benford_anomaly"] = with_views("SELECT * FROM a_benford", "a_benford").replace("{limit}", "0.01")


def cut_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their entries' amounts cut to whole 50,000s, so that equal neighbours occur."""
    coarse = F.floor(F.col("amount") / 50000) * F.lit(50000).cast("decimal(18,2)")
    return staged(spark, sf_dir).lines.withColumn("amount", coarse)


define("a_reversal", """
SELECT engagement_id, 'other' AS anomaly_type, 'warning' AS severity, entry_id, entry_number,
 concat('Possibile round-tripping: registrazione ', entry_number, ' inverte la ', p.entry_number, ' sullo stesso conto ''', account,
  ''' entro ', registration_date - p.registration_date, ' giorni (importo: ', p.amount, ')') AS description, account FROM (
 SELECT *, lag(struct_pack(side, registration_date, amount, entry_number)) OVER (PARTITION BY engagement_id, account
   ORDER BY registration_date, load_order, position) AS p,
  count(*) OVER (PARTITION BY engagement_id, account) AS uses FROM (
  SELECT l.engagement_id, l.entry_id, l.account, l.position, CASE WHEN l.debit > 0 THEN 'D' ELSE 'A' END AS side,
   t.entry_number, t.registration_date, t.load_order, {amount} AS amount
  FROM line_view l JOIN totalled t ON t.engagement_id = l.engagement_id AND t.entry_id = l.entry_id) x) y
WHERE uses >= 3 AND p.side <> side AND registration_date - p.registration_date <= 7 AND abs(p.amount - amount) < 0.01""",
       "line_view", "totalled")
_add("E20_quick_reversals", lambda s, d: _flat(A.quick_reversals(cut_movements(s, d)), "account"), "SELECT * FROM a_reversal", "a_reversal")
ORACLE["E20_quick_reversals"] = ORACLE["E20_quick_reversals"].replace(
    "{amount}", "CAST(floor(t.amount / 50000) * 50000 AS DECIMAL(38,2))")


def month_end_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a third of all dates moved to the 28th, so that month ends stand out."""
    day = F.col("registration_date")
    late = F.make_date(F.year(day), F.month(day), F.lit(28))
    return totalled(spark, sf_dir).withColumn("registration_date", F.when(F.col("load_order") % 4 == 0, late).otherwise(day))


define("a_spike", """
SELECT engagement_id, 'other' AS anomaly_type, 'info' AS severity, '' AS entry_id, CAST(0 AS BIGINT) AS entry_number,
 concat('Concentrazione anomala a fine mese (', d, '): ', n, ' registrazioni vs media di ',
  CAST(total / days AS DECIMAL(18,1)), '/giorno') AS description, CAST(CAST(n / (total / days) AS DECIMAL(18,2)) AS VARCHAR) AS ratio FROM (
 SELECT *, count(*) OVER (PARTITION BY engagement_id) AS days, CAST(sum(n) OVER (PARTITION BY engagement_id) AS BIGINT) AS total FROM (
  SELECT engagement_id, {day} AS d, count(*) AS n, sum(amount) AS a FROM totalled GROUP BY ALL) x) y
WHERE total >= 20 AND days >= 5 AND day(d) >= 28 AND n * days > 2 * total""", "totalled")
_add("E21_month_end_spikes", lambda s, d: _flat(A.month_end_spikes(month_end_entries(s, d)), "ratio"), "SELECT * FROM a_spike", "a_spike")
ORACLE["E21_month_end_spikes"] = ORACLE["E21_month_end_spikes"].replace(
    "{day}", "CASE WHEN load_order % 4 = 0 THEN make_date(year(registration_date), month(registration_date), 28) ELSE registration_date END")


def lines_with_rare_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines where every 97th entry uses an account of its own."""
    own = F.concat(F.lit("X"), F.floor(F.col("entry_number") / 97))
    rare = (F.col("entry_number") % 97 == 0) & F.col("account").like("%7")
    return staged(spark, sf_dir).lines.withColumn("account", F.when(rare, own).otherwise(F.col("account")))


_add("E22_unusual_accounts",
     lambda s, d: _flat(A.unusual_accounts(lines_with_rare_accounts(s, d)), "usage_count", "last_number"), """
SELECT engagement_id, 'unusual_account' AS anomaly_type, 'info' AS severity, f[1].entry_id AS entry_id, f[1].entry_number AS entry_number,
 concat('Conto ''', account, ''' usato raramente (', uses, ' volte) ma con importo totale significativo: ', total) AS description,
 CAST(uses AS VARCHAR) AS usage_count, CAST(f[-1].entry_number AS VARCHAR) AS last_number FROM (
 SELECT engagement_id, account, CAST(sum(n) AS BIGINT) AS uses, sum(amount) AS total,
  array_agg(struct_pack(entry_id, entry_number) ORDER BY load_order) AS f FROM (
  SELECT l.engagement_id, l.account, t.entry_id, t.entry_number, t.load_order, t.amount, count(*) AS n FROM (
   SELECT * REPLACE (CASE WHEN entry_number % 97 = 0 AND account LIKE '%7' THEN concat('X', CAST(floor(entry_number / 97) AS BIGINT))
     ELSE account END AS account) FROM line_view) l
  JOIN totalled t ON t.engagement_id = l.engagement_id AND t.entry_id = l.entry_id GROUP BY ALL) x GROUP BY ALL) y
WHERE uses <= 2 AND total > 1000""", "line_view", "totalled")

_COLUMNS = "engagement_id, anomaly_type, severity, entry_id, entry_number, description"
define("found", f"""
SELECT {_COLUMNS} FROM a_unbalanced WHERE entry_id IN (SELECT entry_id FROM sampled)
UNION ALL SELECT {_COLUMNS} FROM a_description WHERE entry_id IN (SELECT entry_id FROM sampled)
UNION ALL SELECT {_COLUMNS} FROM a_lines WHERE entry_id IN (SELECT entry_id FROM sampled)
UNION ALL SELECT {_COLUMNS} FROM a_weekend WHERE entry_id IN (SELECT entry_id FROM sampled)
UNION ALL SELECT {_COLUMNS} FROM a_account WHERE entry_id IN (SELECT entry_id FROM sampled)
UNION ALL SELECT {_COLUMNS} FROM a_gap UNION ALL SELECT {_COLUMNS} FROM a_duplicate""",
       "a_unbalanced", "a_description", "a_lines", "a_weekend", "a_account", "a_gap", "a_duplicate", "sampled")


def found_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.all_anomalies(staged(spark, sf_dir), drawn(spark, sf_dir), chart_of_accounts(spark, sf_dir))


def advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.advanced_anomalies(staged(spark, sf_dir))


def sample_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = drawn(spark, sf_dir).select("engagement_id", "entry_id")
    return validations(spark, sf_dir).join(own, ["engagement_id", "entry_id"], "left_semi")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.severity_counts(sample_validations(spark, sf_dir), found_anomalies(spark, sf_dir))


_add("E23_all_anomalies", lambda s, d: _flat(found_anomalies(s, d)), "SELECT * FROM found", "found")
_add("E23_advanced_anomalies", lambda s, d: _flat(advanced(s, d)), f"""
SELECT {_COLUMNS} FROM a_benford UNION ALL SELECT {_COLUMNS} FROM a_reversal UNION ALL SELECT {_COLUMNS} FROM a_spike
UNION ALL SELECT engagement_id, 'unusual_account', 'info', f[1].entry_id, f[1].entry_number,
 concat('Conto ''', account, ''' usato raramente (', uses, ' volte) ma con importo totale significativo: ', total) FROM (
 SELECT engagement_id, account, CAST(sum(n) AS BIGINT) AS uses, sum(amount) AS total,
  array_agg(struct_pack(entry_id := entry_id, entry_number := entry_number) ORDER BY load_order) AS f FROM (
  SELECT l.engagement_id, l.account, t.entry_id, t.entry_number, t.load_order, t.amount, count(*) AS n
  FROM line_view l JOIN totalled t ON t.engagement_id = l.engagement_id AND t.entry_id = l.entry_id GROUP BY ALL) x GROUP BY ALL) y
WHERE uses <= 2 AND total > 1000""", "a_benford", "a_reversal", "a_spike", "line_view", "totalled")
ORACLE["E23_advanced_anomalies"] = (
    ORACLE["E23_advanced_anomalies"].replace("{limit}", "0.15").replace("{amount}", "t.amount").replace("{day}", "registration_date"))
define("tally", """
SELECT engagement_id, coalesce(v, 0) AS entries_validated, coalesce(i, 0) AS entries_with_issues,
 coalesce(k, 0) AS critical_anomalies, coalesce(w, 0) AS warning_anomalies FROM (
 SELECT engagement_id, count(*) AS v, count(*) FILTER (WHERE NOT is_valid) AS i FROM validated
 WHERE entry_id IN (SELECT entry_id FROM sampled) GROUP BY 1) a FULL JOIN (
 SELECT engagement_id, count(*) FILTER (WHERE severity = 'critical') AS k, count(*) FILTER (WHERE severity = 'warning') AS w
 FROM found GROUP BY 1) b USING (engagement_id)""", "validated", "sampled", "found")
_add("E24_severity_counts", counts, "SELECT * FROM tally", "tally")
define("status", """
SELECT *, CASE WHEN entries_validated = 0 OR critical_anomalies > 0 THEN 'wip' ELSE '✓' END AS status,
 CASE WHEN entries_validated = 0 THEN 'Nessuna registrazione analizzata - in attesa del libro giornale'
  WHEN critical_anomalies > 0 THEN concat('Rilevate ', critical_anomalies, ' anomalie critiche su ', entries_validated,
   ' registrazioni campionate - richiede revisione')
  WHEN warning_anomalies > 0 THEN concat('Test completato su ', entries_validated, ' registrazioni. ', warning_anomalies,
   ' note di attenzione, nessuna anomalia critica.')
  ELSE concat('Test completato su ', entries_validated, ' registrazioni. Nessuna anomalia rilevata.') END AS reasoning FROM tally""", "tally")
_add("E25_run_status", lambda s, d: P.run_status(counts(s, d)), "SELECT * FROM status", "status")
_add("E26_anomaly_report", lambda s, d: P.report_anomalies(found_anomalies(s, d), shown_notes=10), """
SELECT engagement_id, severity, entry_number, anomaly_type, description FROM (
 SELECT *, row_number() OVER (PARTITION BY engagement_id, severity ORDER BY entry_number, anomaly_type, description) AS rn FROM found) t
WHERE severity <> 'info' OR rn <= 10""", "found")
_add("E26_sample_report", lambda s, d: P.report_sample(drawn(s, d), sample_validations(s, d), shown=10, text_width=30), """
SELECT engagement_id, CAST(rn AS INT) AS position, entry_number, registration_date, left(description, 30) AS description, total_debit, total_credit,
 CASE WHEN is_valid THEN '✓' ELSE '⚠' END AS outcome FROM (
 SELECT s.*, v.is_valid, row_number() OVER (PARTITION BY s.engagement_id ORDER BY
  list_position(['threshold', 'focus_account', 'unbalanced', 'round_amount', 'random'], sample_reason), load_order) AS rn
 FROM sampled s JOIN validated v ON v.engagement_id = s.engagement_id AND v.entry_id = s.entry_id) t WHERE rn <= 10""",
     "sampled", "validated")


def run_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = P.result_as_evidence(P.run_status(counts(spark, sf_dir)), statistics(spark, sf_dir), "giornale.csv")
    listed = F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["kind"], f["value"])), ";")
    return evidence.withColumn("fields", listed)


_add("E27_result_as_evidence", run_evidence, """
SELECT engagement_id, 'D.1' AS item_id, entries_validated > 0 AS found, CASE WHEN entries_validated > 0 THEN 'giornale.csv' END AS source_path,
 'Libro giornale' AS source_name, concat('jet_entries_total=', total_entries, ';jet_entries_sampled=', sample_size,
  ';jet_critical_anomalies=', critical_anomalies, ';jet_warning_anomalies=', warning_anomalies) AS fields,
 'jet_analysis' AS method, CAST(CASE WHEN entries_validated > 0 THEN 0.9 ELSE 0 END AS DECIMAL(3,2)) AS confidence,
 concat('Campionate ', sample_size, ' registrazioni su ', total_entries) AS excerpt, reasoning AS notes
FROM stats LEFT JOIN status USING (engagement_id)""", "stats", "status")
