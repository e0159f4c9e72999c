"""Queries over the journal: criteria (J), numbering (Q), result tables (R), event rate (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.constants import CRITERIA
from tallywright.functions.calendars import holiday_calendar, weekend_calendar
from tallywright.operators import criteria as J, numbering as Q, results as R
from tallywright.operators.event_rate import over_limit_events
from tallywright.plans.views import define, journal, parameters, table, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, build, sql: str | None, *views: str) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE[name] = with_views(sql, *views) if views else sql


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.score_journal(journal(spark, sf_dir), parameters(spark))


def scored_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every row scored with its reasons, riskiest first."""
    columns = ["engagement_id", "load_order", "entry_id", "net_amount", "risk_score", "to_investigate", "reasons"]
    return scored(spark, sf_dir).select(*columns).orderBy(F.desc("risk_score"), "load_order")


_add("J00_scored_journal", scored_journal,
     "SELECT engagement_id, load_order, entry_id, net_amount, risk_score, to_investigate, reasons FROM scored", "scored")


def _flag_query(flag: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = J.evaluate_rows(journal(spark, sf_dir), parameters(spark), [flag])
        extra = ["account_rows"] if flag == "rare_account" else []
        return rows.select("engagement_id", "load_order", flag, *extra)

    return build


for _number, (_flag, _, _) in enumerate(CRITERIA, 1):
    _extra = ", account_rows" if _flag == "rare_account" else ""
    _add(f"J{_number:02d}_{_flag}", _flag_query(_flag),
         f"SELECT engagement_id, load_order, {_flag}{_extra} FROM flags", "flags")

_add("J14_risk_score", lambda s, d: scored(s, d).select("engagement_id", "load_order", "risk_score"),
     "SELECT engagement_id, load_order, risk_score FROM scored", "scored")
_add("J15_to_investigate", lambda s, d: scored(s, d).select("engagement_id", "load_order", "to_investigate"),
     "SELECT engagement_id, load_order, to_investigate FROM scored", "scored")
_add("J16_population_mean", lambda s, d: J.population_mean(journal(s, d)),
     "SELECT engagement_id, abs_sum, abs_rows, CAST(abs_sum / abs_rows AS DECIMAL(18,4)) AS population_mean FROM mean_stats",
     "mean_stats")
_add("J17_account_frequency", lambda s, d: J.account_frequency(journal(s, d)), "SELECT * FROM freq", "freq")


def holiday_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows posted on a holiday of each country in the calendar."""
    days = journal(spark, sf_dir).groupBy("engagement_id", "effective_date").agg(F.count(F.lit(1)).alias("journal_rows"))
    return days.join(holiday_calendar(spark), F.col("effective_date") == F.col("holiday")).select(
        "country", "holiday", "engagement_id", "journal_rows")


_add("J18_holiday_calendar", holiday_postings, """
SELECT country, holiday, engagement_id, count(*) AS journal_rows FROM journal JOIN (VALUES
 ('IT', DATE '2024-01-01'), ('IT', DATE '2024-01-06'), ('DE', DATE '2024-01-01'), ('FR', DATE '2024-01-01'),
 ('ES', DATE '2024-01-01'), ('ES', DATE '2024-01-06'), ('US', DATE '2024-01-01'), ('US', DATE '2024-01-15'),
 ('MT', DATE '2024-01-01'), ('IE', DATE '2024-01-01'), ('CY', DATE '2024-01-01'), ('CY', DATE '2024-01-06'),
 ('MT', DATE '2024-02-10'), ('IE', DATE '2024-02-05'), ('US', DATE '2024-02-19')
) AS h(country, holiday) ON effective_date = holiday GROUP BY ALL""", "journal")


def weekend_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = journal(spark, sf_dir).groupBy(
        "engagement_id", F.weekday("effective_date").alias("weekday")).agg(F.count(F.lit(1)).alias("journal_rows"))
    return days.join(weekend_calendar(spark), "weekday").select("country", "weekday", "engagement_id", "journal_rows")


_add("J19_weekend_calendar", weekend_postings, """
SELECT country, CAST(isodow(effective_date) - 1 AS INT) AS weekday, engagement_id, count(*) AS journal_rows
FROM journal JOIN (SELECT unnest(['IT','DE','FR','ES','US','MT','IE','CY']) AS country, [5, 6] AS days
 UNION ALL SELECT 'IL', [4, 5]) w ON list_contains(days, CAST(isodow(effective_date) - 1 AS INT)) GROUP BY ALL""", "journal")
_add("J20_reasons", lambda s, d: scored(s, d).select("engagement_id", "load_order", "reasons"),
     "SELECT engagement_id, load_order, reasons FROM scored", "scored")
_add("J21_run_summary", lambda s, d: J.run_summary(scored(s, d)), """
SELECT engagement_id, count(*) AS journal_rows, count(*) FILTER (WHERE to_investigate) AS rows_to_investigate,
 max(coalesce(CAST(mean_entry AS DECIMAL(18,4)), CAST(abs_sum / abs_rows AS DECIMAL(18,4)))) AS effective_mean
FROM scored GROUP BY engagement_id""", "scored")
_add("J22_criterion_coverage", lambda s, d: J.criterion_coverage(scored(s, d)), " UNION ALL ".join(
    f"SELECT engagement_id, '{f}' AS criterion, count(*) FILTER (WHERE {f}) AS rows_true, "
    f"count(*) FILTER (WHERE NOT {f}) AS rows_false, count(*) FILTER (WHERE {f} IS NULL) AS rows_not_computable "
    "FROM flags GROUP BY engagement_id" for f, _, _ in CRITERIA), "flags")


def _without(flag: str) -> str:
    own = f"CASE WHEN {flag} THEN coalesce(w_{flag}, 0) ELSE 0 END"
    other = {"weekend": "holiday", "holiday": "weekend"}.get(flag)
    if other is None:
        return own
    rest = f"CASE WHEN {other} THEN w_{other} ELSE 0 END"
    return f"(greatest({own}, {rest}) - {rest})"


_add("J23_score_without_criterion", lambda s, d: J.score_without_criterion(scored(s, d)), " UNION ALL ".join(
    f"SELECT engagement_id, '{f}' AS criterion, count(*) FILTER (WHERE risk_score - {_without(f)} >= investigate_threshold) "
    "AS rows_still_over FROM scored GROUP BY engagement_id" for f, _, _ in CRITERIA), "scored")
_add("J24_account_profile", lambda s, d: J.account_profile(J.account_frequency(journal(s, d))), """
SELECT engagement_id, count(*) AS distinct_accounts, count(*) FILTER (WHERE account_rows = 1) AS used_once,
 count(*) FILTER (WHERE account_rows < 5) AS used_under_5, count(*) FILTER (WHERE account_rows < 10) AS used_under_10,
 count(*) FILTER (WHERE account_rows > 1000) AS used_over_1000, max(account_rows) AS max_frequency,
 CAST(coalesce(sum(account_rows) FILTER (WHERE account_rows < 5), 0) AS BIGINT) AS rows_on_used_under_5
FROM freq GROUP BY engagement_id""", "freq")


def account_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal with every third account code turned into digits."""
    digits = F.when(F.col("load_order") % 3 == 0, F.translate("account", "CR", "9")).otherwise(F.col("account"))
    return J.account_code_kinds(journal(spark, sf_dir).withColumn("account", digits))


_add("J25_account_code_kinds", account_kinds, """
SELECT *, CAST(numeric_accounts * 100 / journal_rows AS DECIMAL(9,4)) AS numeric_share,
 CAST(text_accounts * 100 / journal_rows AS DECIMAL(9,4)) AS text_share,
 CAST(empty_accounts * 100 / journal_rows AS DECIMAL(9,4)) AS empty_share FROM (
 SELECT engagement_id, count(*) AS journal_rows,
  count(*) FILTER (WHERE regexp_matches(code, '^[0-9]+$')) AS numeric_accounts,
  count(*) FILTER (WHERE NOT regexp_matches(code, '^[0-9]+$')) AS text_accounts,
  count(*) FILTER (WHERE code IS NULL) AS empty_accounts
 FROM (SELECT engagement_id, CASE WHEN load_order % 3 = 0 THEN replace(replace(account, 'C', '9'), 'R', '') ELSE account END AS code
       FROM journal) t GROUP BY engagement_id) u""", "journal")

# --- numbering -----------------------------------------------------------------------------------

define("number_pairs", """
SELECT *, following - previous - 1 AS missing FROM (
 SELECT engagement_id, n AS previous, lead(n) OVER (PARTITION BY engagement_id ORDER BY n) AS following
 FROM (SELECT DISTINCT engagement_id, CAST(document_number AS HUGEINT) AS n FROM journal
       WHERE regexp_matches(document_number, '^[0-9]+$')) t) u WHERE following - previous > 1
""", "journal")
_add("Q01_sequence_missing", lambda s, d: Q.sequence_missing(journal(s, d)), """
SELECT engagement_id, CAST(unnest(range(CAST(previous + 1 AS BIGINT), CAST(following AS BIGINT))) AS VARCHAR) AS expected_number,
 CAST(NULL AS VARCHAR) AS found_number, true AS is_missing
FROM number_pairs WHERE missing <= 10000""", "number_pairs")
_add("Q02_sequence_wide_gaps", lambda s, d: Q.sequence_wide_gaps(journal(s, d), max_gap=5), """
SELECT engagement_id, CAST(previous AS VARCHAR) AS previous_number, CAST(following AS VARCHAR) AS next_number,
 CAST(missing AS VARCHAR) AS missing_count FROM number_pairs WHERE missing > 5""", "number_pairs")

# --- result tables -------------------------------------------------------------------------------

_RESULT = ["engagement_id", "load_order", "entry_id", "account", "net_amount", "risk_score", "to_investigate"]
_RESULT_SQL = ", ".join(_RESULT)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(*_RESULT)


_add("R01_filter_results",
     lambda s, d: R.filter_results(results(s, d), to_investigate=True, account="C2", minimum_score=5),
     f"SELECT {_RESULT_SQL} FROM scored WHERE to_investigate AND account = 'C2' AND risk_score >= 5", "scored")
_add("R02_page_results",
     lambda s, d: R.page_results(results(s, d), page=2, size=50),
     f"SELECT {_RESULT_SQL} FROM scored ORDER BY risk_score DESC, load_order LIMIT 50 OFFSET 50",
     "scored")
_add("R02_page_totals", lambda s, d: R.page_totals(results(s, d), size=50),
     "SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM scored", "scored")
_JOURNAL_TEXT = ["engagement_id", "load_order", "description", "user_name", "account"]
_add("R03_table_search", lambda s, d: R.table_search(journal(s, d).select(*_JOURNAL_TEXT), "U7"), """
SELECT engagement_id, load_order, description, user_name, account FROM journal
WHERE contains(lower(engagement_id), 'u7') OR contains(CAST(load_order AS VARCHAR), 'u7')
 OR contains(lower(coalesce(description, '')), 'u7') OR contains(lower(coalesce(user_name, '')), 'u7')
 OR contains(lower(coalesce(account, '')), 'u7')""", "journal")
_add("R04_column_contains",
     lambda s, d: R.column_contains(journal(s, d).select(*_JOURNAL_TEXT), {"description": "PURCH", "account": "c3", "user_name": ""}), """
SELECT engagement_id, load_order, description, user_name, account FROM journal
WHERE contains(lower(description), 'purch') AND contains(lower(account), 'c3')""", "journal")
_add("R05_null_aware_sort",
     lambda s, d: R.null_aware_sort(journal(s, d).select(*_JOURNAL_TEXT), "account", "desc"),
     "SELECT engagement_id, load_order, description, user_name, account FROM journal ORDER BY account DESC NULLS FIRST", "journal")

define("sources", """
SELECT concat('F', CAST(s_suppkey AS VARCHAR)) AS source_id, concat('N', CAST(s_nationkey AS VARCHAR)) AS engagement_id,
 s_name AS file_name, CAST(round(s_acctbal / 1000) AS BIGINT) AS created_at, s_suppkey AS seq,
 s_suppkey % 7 <> 0 AS active,
 CASE WHEN s_suppkey % 5 = 0 THEN 'errore' WHEN s_suppkey % 3 = 0 THEN 'caricata' ELSE 'pronta' END AS state,
 CASE WHEN s_suppkey % 2 = 0 THEN 'txt' ELSE 'xlsx' END AS file_format
FROM supplier""")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("F"), key).alias("source_id"),
        F.concat(F.lit("N"), "s_nationkey").alias("engagement_id"),
        F.col("s_name").alias("file_name"),
        F.round(F.col("s_acctbal") / 1000).cast("bigint").alias("created_at"),
        key.alias("seq"),
        (key % 7 != 0).alias("active"),
        F.when(key % 5 == 0, "errore").when(key % 3 == 0, "caricata").otherwise("pronta").alias("state"),
        F.when(key % 2 == 0, "txt").otherwise("xlsx").alias("file_format"),
    )


_add("R06_latest_source", lambda s, d: R.latest_source(sources(s, d)), """
SELECT source_id, engagement_id, file_name, created_at, seq, active, state, file_format FROM (
 SELECT *, row_number() OVER (PARTITION BY engagement_id ORDER BY created_at DESC, seq DESC) AS rn FROM sources) t
WHERE rn = 1""", "sources")


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    engagements = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), "n_nationkey").alias("engagement_id"),
        (F.col("n_nationkey") % 4 != 0).alias("has_parameters"))
    return R.analysis_readiness(engagements, sources(spark, sf_dir))


_add("R07_analysis_readiness", readiness, """
SELECT *, blockers = '' AS ready FROM (
 SELECT engagement_id, sources, active_sources, sources_in_error, sources_without_profile, sources_without_mapping,
  concat_ws(', ', CASE WHEN NOT has_parameters THEN 'parametri' END,
   CASE WHEN sources > 0 AND active_sources = 0 THEN 'almeno una fonte attiva' END,
   CASE WHEN sources = 0 THEN 'nessuna fonte' END,
   CASE WHEN sources_in_error > 0 THEN 'fonte non valida' END,
   CASE WHEN sources_without_profile > 0 THEN 'profilo di estrazione' END,
   CASE WHEN sources_without_mapping > 0 THEN 'mappatura colonne' END) AS blockers
 FROM (SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS engagement_id, n_nationkey % 4 <> 0 AS has_parameters,
   count(s.source_id) AS sources, count(*) FILTER (WHERE active) AS active_sources,
   count(*) FILTER (WHERE active AND state = 'errore') AS sources_in_error,
   count(*) FILTER (WHERE active AND state = 'caricata' AND file_format = 'txt') AS sources_without_profile,
   count(*) FILTER (WHERE active AND state = 'caricata' AND file_format = 'xlsx') AS sources_without_mapping
  FROM nation LEFT JOIN sources s
   ON s.engagement_id = concat('N', CAST(n_nationkey AS VARCHAR)) GROUP BY 1, 2) t) u""", "sources")

# --- event rate ----------------------------------------------------------------------------------


def event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts")
    return over_limit_events(events, max_events=3, window_seconds=6 * 3600)


_add("X01_over_limit_events", event_rate, """
SELECT key, ts, earlier, earlier >= 3 AS over_limit, greatest(0, 3 - earlier - 1) AS remaining FROM (
 SELECT key, ts, count(*) OVER (PARTITION BY key ORDER BY epoch_us(ts)
  RANGE BETWEEN 21599999999 PRECEDING AND 1 PRECEDING) AS earlier
 FROM (SELECT DISTINCT user_id AS key, ts FROM events) t) u""")
