"""Pattern tests over whole populations of entries, and the union of all anomalies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tallywright.constants import FIRST_DIGIT_SHARES
from tallywright.functions.ordered import BUCKET_ROWS, neighbours, number_bucket
from tallywright.functions.tables import broadcast_if_bounded
from tallywright.operators import entries as E
from tallywright.operators.entries import ENTRY_KEY, anomaly
from tallywright.operators.entry_layout import EntryJournal

MINIMUM_DIGITS = 50
DEVIATION_LIMIT = "0.15"


def first_digit_distribution(totalled: DataFrame) -> DataFrame:
    """Observed and expected first-digit shares of entry amounts, nine rows per engagement."""
    digit = F.left(F.col("amount").cast("string"), F.lit(1))
    usable = totalled.filter(F.col("amount") >= 1).select("engagement_id", digit.alias("digit"))
    counts = [F.count_if(F.col("digit") == d).alias(f"d{d}") for d in FIRST_DIGIT_SHARES]
    wide = usable.groupBy("engagement_id").agg(F.count(F.lit(1)).alias("sample_size"), *counts)
    rows = ", ".join(f"'{d}', d{d}, CAST({share} AS DECIMAL(9,6))" for d, share in FIRST_DIGIT_SHARES.items())
    long = wide.filter(F.col("sample_size") >= MINIMUM_DIGITS).selectExpr(
        "engagement_id", "sample_size", f"stack(9, {rows}) AS (digit, digit_rows, expected)"
    )
    observed = (F.col("digit_rows") / F.col("sample_size")).cast("decimal(9,6)")
    return long.withColumn("observed", observed).withColumn(
        "deviation", F.abs(F.col("observed") - F.col("expected")).cast("decimal(9,6)")
    )


def benford_first_digit(totalled: DataFrame, limit: str = DEVIATION_LIMIT) -> DataFrame:
    """A warning per engagement whose largest deviation exceeds the limit; the lower digit wins a tie."""
    worst = F.max_by(
        F.struct("digit", "observed", "expected", "deviation", "sample_size"),
        F.struct("deviation", -F.col("digit").cast("int")),
    )
    per = first_digit_distribution(totalled).groupBy("engagement_id").agg(worst.alias("w"))
    rows = per.select("engagement_id", "w.*").filter(F.col("deviation") > F.lit(limit).cast("decimal(9,6)"))
    c = F.col
    percent = lambda name: (c(name) * 100).cast("decimal(9,1)")
    text = E._say(
        "Distribuzione delle prime cifre devia dalla Legge di Benford: cifra '{d}' devia del {x}% "
        "(osservato: {o}%, atteso: {e}%)",
        d=c("digit"), x=percent("deviation"), o=percent("observed"), e=percent("expected"),
    )
    whole = rows.withColumns({"entry_id": F.lit(""), "entry_number": F.lit(0).cast("bigint")})
    return anomaly(
        whole, "other", "warning", text, analysis_type=F.lit("benford"), sample_size=c("sample_size"),
        max_deviation=c("deviation"), max_deviation_digit=c("digit"),
    )


def quick_reversals(lines: DataFrame, window_days: int = 7, busy_rows: int = BUCKET_ROWS) -> DataFrame:
    """Neighbouring movements of an account on opposite sides with the same entry amount, from laid-out lines.

    Movements of an account are ordered by date, load order and position in the entry. An account with more than
    ``busy_rows`` movements is cut into (date, load-order range), all others are one run; there are at most
    ``lines / busy_rows`` such accounts, and their table is broadcast where that bound is small.
    """
    account = ["engagement_id", "account"]
    movements = lines.filter("account IS NOT NULL AND load_order IS NOT NULL").select(
        *account, "entry_id", "entry_number", "registration_date", "load_order", "position", "amount", (F.col("debit") > 0).alias("debited"))
    usage = lines.filter("account IS NOT NULL").groupBy(*account).agg(F.count(F.lit(1)).alias("uses"))
    busy = usage.filter(F.col("uses") > busy_rows).select(*account, F.lit(True).alias("_busy"))
    marked = movements.join(broadcast_if_bounded(busy, lines, busy_rows), account, "left")
    cut = marked.withColumns({
        "_day": F.when(F.col("_busy"), F.col("registration_date")), "_range": F.when(F.col("_busy"), number_bucket("load_order", 100_000))})
    days = F.date_diff(F.col("next_registration_date"), F.col("registration_date"))
    turned = (
        (F.col("debited") != F.col("next_debited"))
        & (days <= window_days)
        & (F.abs(F.col("amount") - F.col("next_amount")) < F.lit("0.01").cast("decimal(3,2)"))
    )
    pairs = neighbours(cut, account, ["_day", "_range"], ["registration_date", "load_order", "position"],
                       ["entry_id", "entry_number", "amount", "debited"], turned)
    rows = pairs.select(
        *account, F.col("next_entry_id").alias("entry_id"), F.col("next_entry_number").alias("entry_number"),
        F.col("entry_number").alias("first_number"), "amount", days.alias("days"),
    ).join(usage.filter("uses >= 3"), account, "left_semi")
    c = F.col
    text = E._say(
        "Possibile round-tripping: registrazione {b} inverte la {a} sullo stesso conto '{k}' entro {d} giorni "
        "(importo: {m})",
        b=c("entry_number"), a=c("first_number"), k=c("account"), d=c("days"), m=c("amount"),
    )
    return anomaly(
        rows, "other", "warning", text, account=c("account"), entry1_number=c("first_number"),
        entry2_number=c("entry_number"), amount=c("amount"), days_between=c("days"),
    )


def month_end_spikes(totalled: DataFrame, factor: int = 2) -> DataFrame:
    """Days from the 28th on with more than ``factor`` times the mean entries per active day."""
    daily = totalled.groupBy("engagement_id", "registration_date").agg(
        F.count(F.lit(1)).alias("day_entries"), F.sum("amount").alias("total_amount")
    )
    engagement = W.partitionBy("engagement_id")  # one row per calendar day
    spread = daily.withColumns(
        {"active_days": F.count(F.lit(1)).over(engagement), "all_entries": F.sum("day_entries").over(engagement)}
    )
    c = F.col
    spikes = spread.filter(
        (c("all_entries") >= 20)
        & (c("active_days") >= 5)
        & (F.day("registration_date") >= 28)
        & (c("day_entries") * c("active_days") > c("all_entries") * factor)
    )
    mean = c("all_entries") / c("active_days")
    shown = spikes.withColumns(
        {
            "entry_id": F.lit(""),
            "entry_number": F.lit(0).cast("bigint"),
            "average_daily": mean.cast("decimal(18,1)"),
            "ratio": (c("day_entries") / mean).cast("decimal(18,2)"),
        }
    )
    text = E._say(
        "Concentrazione anomala a fine mese ({d}): {k} registrazioni vs media di {m}/giorno",
        d=c("registration_date"), k=c("day_entries"), m=c("average_daily"),
    )
    return anomaly(
        shown, "other", "info", text, date=c("registration_date"), count=c("day_entries"),
        average_daily=c("average_daily"), ratio=c("ratio"), total_amount=c("total_amount"),
    )


def unusual_accounts(lines: DataFrame, maximum_uses: int = 2, minimum_total: int = 1000) -> DataFrame:
    """Accounts used at most ``maximum_uses`` times whose distinct entries total more than the minimum, from laid-out lines.

    Uses are counted first; the rest looks only at the few lines of the rare accounts.
    """
    account = ["engagement_id", "account"]
    usage = lines.groupBy(*account).agg(F.count(F.lit(1)).alias("usage_count")).filter(F.col("usage_count") <= maximum_uses)
    own = lines.filter("load_order IS NOT NULL").join(usage, account)
    per_entry = own.select(*account, "usage_count", "entry_id", "entry_number", "load_order", "amount").distinct()
    per_account = per_entry.groupBy(*account).agg(
        F.max("usage_count").alias("usage_count"),
        F.sum("amount").alias("total_amount"),
        F.min_by("entry_id", "load_order").alias("entry_id"),
        F.min_by("entry_number", "load_order").alias("entry_number"),
        F.max_by("entry_number", "load_order").alias("last_number"),
    )
    c = F.col
    rare = per_account.filter(c("total_amount") > minimum_total)
    text = E._say(
        "Conto '{a}' usato raramente ({k} volte) ma con importo totale significativo: {t}",
        a=c("account"), k=c("usage_count"), t=c("total_amount"),
    )
    return anomaly(
        rare, "unusual_account", "info", text, account=c("account"), usage_count=c("usage_count"),
        total_amount=c("total_amount"), first_number=c("entry_number"), last_number=c("last_number"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def all_anomalies(
    journal: EntryJournal, sample: DataFrame, chart: DataFrame | None = None,
    check_sequence: bool = True, check_duplicates: bool = True, listed: int | None = None,
) -> DataFrame:
    """Validations of the sampled entries plus numbering gaps and duplicates of the population."""
    parts = [E.entry_findings(sample)]
    if chart is not None:
        outside = E._lines_outside_chart(journal.rows, chart).join(sample.select(*ENTRY_KEY), ENTRY_KEY, "left_semi")
        parts.append(E._unknown(outside.join(journal.entries.select(*ENTRY_KEY), ENTRY_KEY)))  # once per entry row, as laid-out lines
    if check_sequence:
        parts.append(E.entry_number_gaps(journal.entries, listed))
    if check_duplicates:
        parts.append(E.duplicate_entries(journal.first_lines))
    return _union(parts)


def advanced_anomalies(journal: EntryJournal) -> DataFrame:
    return _union(
        [
            benford_first_digit(journal.entries),
            quick_reversals(journal.lines),
            month_end_spikes(journal.entries),
            unusual_accounts(journal.lines),
        ]
    )
