"""Input views over the driver's tables: a journal, its parameters, entries, lines and documents.

Each view exists twice, as a DataFrame here and as SQL text in ``SQL_VIEWS`` for the comparison.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.constants import CRITERIA
from tallywright.functions.tables import constant_table

SQL_VIEWS: dict[str, str] = {}
DEPENDS: dict[str, list[str]] = {}


def with_views(sql: str, *names: str, instead: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the named SQL views and everything they depend on; ``instead`` has other text for some of them."""
    instead = instead or {}
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in [] if name in instead else DEPENDS.get(name, []):
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    body = ",\n".join(f"{name} AS ({instead.get(name, SQL_VIEWS[name])})" for name in ordered)
    return f"WITH {body}\n{sql}"


def define(name: str, sql: str, *depends: str) -> None:
    SQL_VIEWS[name] = sql
    DEPENDS[name] = list(depends)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- journal -------------------------------------------------------------------------------------

JOURNAL_SQL = """
SELECT concat('E', CAST(user_id % 3 AS STRING)) AS engagement_id,
 event_id AS load_order,
 CAST(ts AS DATE) AS effective_date,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE {created} END AS created_date,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(hour(ts)*3600+minute(ts)*60+floor(second(ts)) AS INT) END AS created_seconds,
 CAST(event_id AS STRING) AS entry_id,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN concat('A', CAST(event_id AS STRING))
      WHEN event_id % 997 = 0 THEN CAST(event_id + 4220425800000000 AS STRING)
      ELSE CAST(event_id AS STRING) END AS document_number,
 CAST(CASE WHEN event_id % 50 = 0 THEN floor(value) * 10 WHEN event_id % 101 = 0 THEN 0
      WHEN event_type = 'purchase' THEN -value ELSE value END AS DECIMAL(18,2)) AS net_amount,
 CASE WHEN event_id % 23 = 0 THEN '  ' WHEN event_id % 29 = 0 THEN NULL
      ELSE concat('Registrazione ', event_type) END AS description,
 CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('U', CAST(user_id AS STRING)) END AS user_name,
 CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 499 = 0 THEN concat('R', CAST(event_id AS STRING))
      ELSE concat('C', CAST(user_id % 40 AS STRING)) END AS account,
 concat('S', CAST(event_id % 5 AS STRING)) AS source_id
FROM {events}
"""

define("journal", JOURNAL_SQL.format(
    created="CAST(ts AS DATE) + CAST(event_id % 90 AS INT)", events="events"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = JOURNAL_SQL.format(
        created="date_add(CAST(ts AS DATE), CAST(event_id % 90 AS INT))", events="{events}")
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


# --- client parameters ---------------------------------------------------------------------------

WEIGHT_VALUES = [1, 1, 1, 1, 1, 4, 1, 4, 4, 4, 4, 2, None]
WEIGHT_NAMES = [weight for _, weight, _ in CRITERIA]

PARAMETER_ROWS = [
    ("E0", Decimal(250), Decimal(3000), None, Decimal(10), 30600, 61200, 60, "IT", 4, 5,
     None, ["2024-01-08"], [f"U{i}" for i in range(100)], ["U0"], ["Purchase", " click ", " "], ["C1", "C2"]),
    ("E1", None, Decimal(2000), Decimal(20), None, 28800, 64800, 30, "IL", 5, None,
     None, None, None, None, None, []),
    ("E2", Decimal(300), None, None, Decimal(5), None, None, None, None, 3, 3,
     [6], ["2024-01-10"], [], None, [], None),
]
PARAMETER_SCHEMA = (
    "engagement_id string, performance_materiality decimal(18,2), net_profit decimal(18,2), "
    "mean_entry decimal(18,2), round_threshold decimal(18,2), office_start int, office_end int, "
    "backdating_days int, country string, investigate_threshold int, rare_account_threshold int, "
    "weekend_days array<int>, manual_holidays array<date>, authorised_users array<string>, "
    "system_users array<string>, keywords array<string>, intragroup_accounts array<string>"
)


def parameters(spark: SparkSession) -> DataFrame:
    base = constant_table(spark, PARAMETER_SCHEMA, PARAMETER_ROWS)
    weights = {name: F.lit(value).cast("int") for name, value in zip(WEIGHT_NAMES, WEIGHT_VALUES)}
    return base.withColumns(weights)


define("params", """
SELECT *, 1 AS w_profit_impact, 1 AS w_over_ten_times_mean, 1 AS w_over_performance_materiality, 1 AS w_round_amount,
 1 AS w_weekend, 4 AS w_holiday, 1 AS w_out_of_hours, 4 AS w_backdated, 4 AS w_unauthorised_user,
 4 AS w_related_party_text, 4 AS w_blank_description, 2 AS w_rare_account, CAST(NULL AS INT) AS w_intragroup_account
FROM (VALUES
 ('E0', 250, 3000, CAST(NULL AS DECIMAL(18,2)), 10, 30600, 61200, 60, 'IT', 4, 5,
  [5, 6], [DATE '2024-01-08', DATE '2024-01-01', DATE '2024-01-06'],
  list_transform(range(100), lambda x: 'U' || x), ['U0'], ['purchase', 'click'], ['C1', 'C2']),
 ('E1', NULL, 2000, 20, NULL, 28800, 64800, 30, 'IL', 5, NULL,
  [4, 5], NULL, NULL, NULL, NULL, []),
 ('E2', 300, NULL, NULL, 5, NULL, NULL, NULL, NULL, 3, 3,
  [6], [DATE '2024-01-10'], [], NULL, [], NULL)
) AS t(engagement_id, performance_materiality, net_profit, mean_entry, round_threshold, office_start, office_end,
 backdating_days, country, investigate_threshold, rare_account_threshold, weekend_list, holiday_list, authorised,
 system_list, keyword_list, intragroup_list)
""")

define("mean_stats", """
SELECT engagement_id, sum(abs(net_amount)) FILTER (WHERE net_amount <> 0) AS abs_sum,
 count(*) FILTER (WHERE net_amount <> 0) AS abs_rows FROM journal GROUP BY engagement_id
""", "journal")

define("freq", """
SELECT engagement_id, account, count(*) AS account_rows FROM journal WHERE account IS NOT NULL
GROUP BY engagement_id, account
""", "journal")

define("flags", """
SELECT j.*, p.investigate_threshold, p.mean_entry, m.abs_sum, m.abs_rows, f.account_rows,
 p.w_profit_impact, p.w_over_ten_times_mean, p.w_over_performance_materiality, p.w_round_amount, p.w_weekend,
 p.w_holiday, p.w_out_of_hours, p.w_backdated, p.w_unauthorised_user, p.w_related_party_text,
 p.w_blank_description, p.w_rare_account, p.w_intragroup_account,
 abs(net_amount) > 0.10 * abs(p.net_profit) AS profit_impact,
 CASE WHEN p.mean_entry IS NOT NULL THEN abs(net_amount) > 10 * abs(p.mean_entry)
      WHEN m.abs_rows > 0 THEN abs(net_amount) * m.abs_rows > 10 * m.abs_sum END AS over_ten_times_mean,
 abs(net_amount) > abs(p.performance_materiality) AS over_performance_materiality,
 abs(net_amount) % p.round_threshold = 0 AS round_amount,
 CASE WHEN p.weekend_list IS NOT NULL THEN list_contains(p.weekend_list, CAST(isodow(effective_date) - 1 AS INT)) END AS weekend,
 CASE WHEN p.holiday_list IS NOT NULL THEN list_contains(p.holiday_list, effective_date) END AS holiday,
 CASE WHEN created_seconds IS NOT NULL AND p.office_start IS NOT NULL AND p.office_end IS NOT NULL
      THEN created_seconds < p.office_start OR created_seconds > p.office_end END AS out_of_hours,
 (created_date - effective_date) >= p.backdating_days AS backdated,
 CASE WHEN p.authorised IS NULL OR user_name IS NULL THEN NULL
      WHEN p.system_list IS NOT NULL AND list_contains(p.system_list, user_name) THEN NULL
      ELSE NOT list_contains(p.authorised, user_name) END AS unauthorised_user,
 CASE WHEN p.keyword_list IS NOT NULL THEN
      len(list_filter(p.keyword_list, lambda k: contains(lower(coalesce(description, '')), k))) > 0 END AS related_party_text,
 trim(coalesce(description, '')) = '' AS blank_description,
 f.account_rows < p.rare_account_threshold AS rare_account,
 CASE WHEN p.intragroup_list IS NOT NULL AND j.account IS NOT NULL THEN list_contains(p.intragroup_list, j.account) END AS intragroup_account
FROM journal j LEFT JOIN params p USING (engagement_id) LEFT JOIN mean_stats m USING (engagement_id)
LEFT JOIN freq f ON f.engagement_id = j.engagement_id AND f.account = j.account
""", "journal", "params", "mean_stats", "freq")

_SINGLE = [f for f, _, _ in CRITERIA if f not in ("weekend", "holiday")]
define("scored", """
SELECT *, risk_score >= investigate_threshold AS to_investigate FROM (SELECT *, CAST({sum} + greatest(
 CASE WHEN weekend THEN w_weekend ELSE 0 END, CASE WHEN holiday THEN w_holiday ELSE 0 END) AS INT) AS risk_score,
 concat_ws(', ', {labels}) AS reasons FROM flags) t
""".format(
    sum=" + ".join(f"CASE WHEN {f} THEN coalesce(w_{f}, 0) ELSE 0 END" for f in _SINGLE),
    labels=", ".join("CASE WHEN {} THEN '{}' END".format(f, label.replace("'", "''")) for f, _, label in CRITERIA),
), "flags")


# --- views whose SQL text is the same in both engines --------------------------------------------

SHARED: dict[str, tuple[str, str]] = {}


def define_shared(name: str, base: str, sql: str) -> None:
    """A view over one table, written in the SQL that both engines read; ``{base}`` is the table."""
    SHARED[name] = (base, sql)
    define(name, sql.replace("{base}", base))


def shared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, sql = SHARED[name]
    return spark.sql(sql, base=table(spark, sf_dir, base))


def italian_amount(cents: str) -> str:
    """SQL text that writes whole cents as an amount with grouped thousands and a decimal comma."""
    euros = f"CAST(floor({cents} / 100) AS BIGINT)"
    return (
        f"concat(CASE WHEN {euros} >= 1000 THEN concat(CAST(CAST(floor({euros} / 1000) AS BIGINT) AS STRING), '.', "
        f"lpad(CAST({euros} % 1000 AS STRING), 3, '0')) ELSE CAST({euros} AS STRING) END, ',', "
        f"lpad(CAST({cents} % 100 AS STRING), 2, '0'))"
    )
