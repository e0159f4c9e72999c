"""Row criteria of the journal test with three-valued logic, scores and population statistics.

A flag is NULL when a parameter or field it needs is missing; NULL gives no points and is never
reported as FALSE. Parameters are one row per engagement, so a single job scores every engagement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallywright.constants import CALENDAR_FIRST_YEAR, CALENDAR_LAST_YEAR, CRITERIA
from tallywright.functions.calendars import country_calendar, holiday_calendar
from tallywright.functions.parsing import strip
from tallywright.functions.tables import broadcast_if_small

FLAGS = [flag for flag, _, _ in CRITERIA]
WEIGHTS = {flag: weight for flag, weight, _ in CRITERIA}
LABELS = {flag: label for flag, _, label in CRITERIA}
LIST_COLUMNS = [
    "weekend_days", "manual_holidays", "authorised_users", "system_users", "keywords", "intragroup_accounts",
]


def population_mean(journal: DataFrame) -> DataFrame:
    """Mean of |net| over non-zero rows per engagement; NULL, never 0, when there are none."""
    amount = F.when(F.col("net_amount") != 0, F.abs("net_amount"))
    stats = journal.groupBy("engagement_id").agg(F.sum(amount).alias("abs_sum"), F.count(amount).alias("abs_rows"))
    return stats.withColumn(
        "population_mean", F.when(F.col("abs_rows") > 0, F.col("abs_sum") / F.col("abs_rows")).cast("decimal(18,4)")
    )


def account_frequency(journal: DataFrame) -> DataFrame:
    present = journal.filter(F.col("account").isNotNull())
    return present.groupBy("engagement_id", "account").agg(F.count(F.lit(1)).alias("account_rows"))


def parameters_from_lists(params: DataFrame, values: DataFrame, present: DataFrame) -> DataFrame:
    """Attach list parameters stored one value per row; ``present`` tells empty lists from missing ones.

    Lists are client parameters (staff, keywords, holidays), a few hundred values each.
    """
    grouped = values.filter(F.col("value").isNotNull()).groupBy("engagement_id", "list_name").agg(
        F.sort_array(F.collect_set("value")).alias("items")
    )
    known = present.join(grouped, ["engagement_id", "list_name"], "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<string>"))
    )
    picks = [F.max(F.when(F.col("list_name") == name, F.col("items"))).alias(name) for name in LIST_COLUMNS]
    wide = known.groupBy("engagement_id").agg(*picks)
    wide = wide.withColumn("weekend_days", F.col("weekend_days").cast("array<int>")).withColumn(
        "manual_holidays", F.col("manual_holidays").cast("array<date>")
    )
    return params.join(wide, "engagement_id", "left")


def _casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def _ready_parameters(params: DataFrame) -> DataFrame:
    """Lists without NULL members, keywords normalised once, country lists attached."""
    ready = params.join(country_calendar(params.sparkSession), "country", "left")
    for name in LIST_COLUMNS:
        if name != "keywords":
            ready = ready.withColumn(name, F.array_compact(name))
    keywords = F.transform(F.array_compact("keywords"), lambda k: _casefold(strip(k)))
    return ready.withColumn("keywords", F.filter(keywords, lambda k: k != ""))


def _flag_expressions(mean_known: bool, frequency_known: bool) -> dict[str, Column]:
    c = F.col
    amount = F.abs("net_amount")
    against_population = (
        amount * c("abs_rows") > c("abs_sum") * 10 if mean_known else F.lit(None).cast("boolean")
    )
    over_mean = F.when(c("mean_entry").isNotNull(), amount > F.abs("mean_entry") * 10).when(
        F.coalesce(c("abs_rows"), F.lit(0)) > 0 if mean_known else F.lit(False), against_population
    )
    weekend_days = F.coalesce(c("weekend_days"), c("country_weekend"))
    in_manual = F.array_contains("manual_holidays", c("effective_date"))
    has_manual = F.coalesce(F.size("manual_holidays") > 0, F.lit(False)) & c("manual_holidays").isNotNull()
    covered = F.coalesce(F.array_contains("covered_years", F.year("effective_date")), F.lit(False))
    holiday = F.when(
        c("country").isNotNull(),
        F.when(covered | has_manual, c("country_holiday").isNotNull() | F.coalesce(in_manual, F.lit(False))),
    ).when(c("manual_holidays").isNotNull(), in_manual)
    seconds = c("created_seconds")
    is_system = F.coalesce(F.array_contains("system_users", c("user_name")), F.lit(False))
    description = strip(F.coalesce(c("description"), F.lit("")))
    folded = _casefold(description)
    rare = c("account_rows") < c("rare_account_threshold") if frequency_known else F.lit(None).cast("boolean")
    return {
        "profit_impact": amount > F.abs("net_profit") * F.lit(0.10).cast("decimal(3,2)"),
        "over_ten_times_mean": over_mean,
        "over_performance_materiality": amount > F.abs("performance_materiality"),
        "round_amount": amount % F.nullif(c("round_threshold"), F.lit(0).cast("decimal(18,2)")) == 0,
        "weekend": F.array_contains(weekend_days, F.weekday("effective_date")),
        "holiday": holiday,
        "out_of_hours": ~F.when(
            seconds.isNotNull() & c("office_start").isNotNull() & c("office_end").isNotNull(),
            seconds.between(c("office_start"), c("office_end")),
        ),
        "backdated": F.date_diff(c("created_date"), c("effective_date")) >= c("backdating_days"),
        "unauthorised_user": F.when(
            c("user_name").isNotNull() & ~is_system, ~F.array_contains("authorised_users", c("user_name"))
        ),
        "related_party_text": F.exists("keywords", lambda k: F.contains(folded, k)),
        "blank_description": description == "",
        "rare_account": rare,
        "intragroup_account": F.array_contains("intragroup_accounts", c("account")),
    }


def evaluate_rows(
    journal: DataFrame,
    params: DataFrame,
    criteria: list[str] | None = None,
    mean: DataFrame | None = None,
    frequency: DataFrame | None = None,
    strict_calendar: bool = False,
) -> DataFrame:
    """Journal rows with one nullable boolean per requested criterion.

    Only the joins that the requested criteria need are planned. ``mean`` and ``frequency`` accept
    population tables written by an earlier job; otherwise they are aggregated from ``journal``.
    """
    wanted = FLAGS if criteria is None else criteria
    spark = journal.sparkSession
    ready = _ready_parameters(params)
    needs_mean = "over_ten_times_mean" in wanted
    needs_frequency = "rare_account" in wanted
    if needs_mean:
        stats = population_mean(journal) if mean is None else mean
        ready = ready.join(stats, "engagement_id", "left")
    rows = journal.join(broadcast_if_small(ready, bound=params), "engagement_id", "left")
    if "holiday" in wanted:
        holidays = holiday_calendar(spark).withColumnRenamed("holiday", "country_holiday")
        rows = rows.join(
            holidays.withColumnRenamed("country", "holiday_country"),
            (F.col("country") == F.col("holiday_country")) & (F.col("effective_date") == F.col("country_holiday")),
            "left",
        )
        if strict_calendar:
            year = F.year("effective_date")
            outside = F.col("country").isNotNull() & ~year.between(CALENDAR_FIRST_YEAR, CALENDAR_LAST_YEAR)
            message = F.concat(F.lit("year not covered by the calendar: "), year)
            rows = rows.withColumn(
                "country_holiday", F.when(outside, F.raise_error(message).cast("date")).otherwise(F.col("country_holiday"))
            )
    if needs_frequency:
        counts = account_frequency(journal) if frequency is None else frequency
        rows = _with_frequency(rows, counts)
    flags = _flag_expressions(needs_mean, needs_frequency)
    return rows.withColumns({name: flags[name] for name in wanted})


def _with_frequency(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Left join by account; rows without account get scattered keys so they share no task."""
    scattered = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("load_order"), F.lit(4096)))
    keyed = rows.withColumn("_account_key", F.coalesce(F.col("account"), scattered))
    renamed = counts.select("engagement_id", F.col("account").alias("_account_key"), "account_rows")
    return keyed.join(renamed, ["engagement_id", "_account_key"], "left").drop("_account_key")


def _points(flag: str) -> Column:
    return F.when(F.col(flag), F.coalesce(F.col(WEIGHTS[flag]), F.lit(0))).otherwise(0)


def risk_score() -> Column:
    """Sum of the weights of TRUE flags; weekend and holiday together add only the larger one."""
    single = [_points(f) for f in FLAGS if f not in ("weekend", "holiday")]
    return reduce(lambda a, b: a + b, single) + F.greatest(_points("weekend"), _points("holiday"))


def reasons() -> Column:
    return F.concat_ws(", ", F.array_compact(F.array(*[F.when(F.col(f), F.lit(LABELS[f])) for f in FLAGS])))


def score_journal(journal: DataFrame, params: DataFrame, **options) -> DataFrame:
    """All thirteen flags, score, verdict and reasons for every journal row."""
    rows = evaluate_rows(journal, params, **options)
    scored = rows.withColumn("risk_score", risk_score())
    return scored.withColumn("to_investigate", F.col("risk_score") >= F.col("investigate_threshold")).withColumn(
        "reasons", reasons()
    )


def run_summary(scored: DataFrame) -> DataFrame:
    """Rows, rows to investigate and the mean in force, per engagement."""
    return scored.groupBy("engagement_id").agg(
        F.count(F.lit(1)).alias("journal_rows"),
        F.count_if("to_investigate").alias("rows_to_investigate"),
        F.max(F.coalesce(F.col("mean_entry").cast("decimal(18,4)"), F.col("population_mean"))).alias("effective_mean"),
    )


def criterion_coverage(scored: DataFrame) -> DataFrame:
    """Per criterion the rows that are TRUE, FALSE and not computable."""
    counts = []
    for flag in FLAGS:
        counts += [
            F.count_if(F.col(flag)).alias(f"{flag}_t"),
            F.count_if(~F.col(flag)).alias(f"{flag}_f"),
            F.count_if(F.col(flag).isNull()).alias(f"{flag}_n"),
        ]
    wide = scored.groupBy("engagement_id").agg(*counts)
    rows = ", ".join(f"'{f}', {f}_t, {f}_f, {f}_n" for f in FLAGS)
    return wide.selectExpr(
        "engagement_id", f"stack({len(FLAGS)}, {rows}) AS (criterion, rows_true, rows_false, rows_not_computable)"
    )


def _points_removed(flag: str) -> Column:
    """Points a row loses without this criterion; of weekend and holiday the other may still count."""
    other = {"weekend": "holiday", "holiday": "weekend"}.get(flag)
    return _points(flag) if other is None else F.greatest(_points(flag), _points(other)) - _points(other)


def score_without_criterion(scored: DataFrame) -> DataFrame:
    """Rows still at or over the threshold if one criterion is left out."""
    counts = [
        F.count_if(F.col("risk_score") - _points_removed(f) >= F.col("investigate_threshold")).alias(f) for f in FLAGS
    ]
    wide = scored.groupBy("engagement_id").agg(*counts)
    rows = ", ".join(f"'{f}', {f}" for f in FLAGS)
    return wide.selectExpr("engagement_id", f"stack({len(FLAGS)}, {rows}) AS (criterion, rows_still_over)")


def account_profile(frequency: DataFrame) -> DataFrame:
    n = F.col("account_rows")
    return frequency.groupBy("engagement_id").agg(
        F.count(F.lit(1)).alias("distinct_accounts"),
        F.count_if(n == 1).alias("used_once"),
        F.count_if(n < 5).alias("used_under_5"),
        F.count_if(n < 10).alias("used_under_10"),
        F.count_if(n > 1000).alias("used_over_1000"),
        F.max(n).alias("max_frequency"),
        F.sum(F.when(n < 5, n).otherwise(0)).alias("rows_on_used_under_5"),
    )


def account_code_kinds(journal: DataFrame) -> DataFrame:
    numeric = F.col("account").rlike("^[0-9]+$")
    share = lambda n: (F.col(n) * 100 / F.col("journal_rows")).cast("decimal(9,4)")
    counted = journal.groupBy("engagement_id").agg(
        F.count(F.lit(1)).alias("journal_rows"),
        F.count_if(numeric).alias("numeric_accounts"),
        F.count_if(~numeric).alias("text_accounts"),
        F.count_if(F.col("account").isNull()).alias("empty_accounts"),
    )
    return counted.withColumns(
        {f"{kind}_share": share(f"{kind}_accounts") for kind in ("numeric", "text", "empty")}
    )
