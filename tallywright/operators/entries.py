"""Entry-level journal tests: assembling entries from lines, totals, validations and duplicates.

``entries``: engagement_id, entry_id, entry_number, registration_date, description, load_order.
``lines``: engagement_id, entry_id, entry_number, position, account, debit, credit.
Order is data: the first entry is the one of lowest ``load_order``, the first line of an entry that of lowest ``position``.
``entry_layout.lay_out`` joins the two once; functions that say "laid-out" read its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallywright.functions.ordered import neighbours, number_bucket
from tallywright.functions.parsing import strip

ENTRY_KEY = ["engagement_id", "entry_id"]
ANOMALY = ["engagement_id", "anomaly_type", "severity", "entry_id", "entry_number", "description", "details"]


def assemble_entries(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Attach every line to the entry it belongs to, as ``entry_start`` and ``entry_number``.

    ``cells`` has ``position`` (unique, rising per key) and ``entry_number`` (NULL where blank). A
    number different from the current one starts an entry; a blank continues it; lines before the
    first number belong to none. Lines are resolved inside position buckets; what crosses a bucket
    border is settled on one summary row per bucket.
    """
    keys = ["source_id"] if keys is None else keys
    rows = cells.withColumn("_bucket", number_bucket("position"))
    inside = W.partitionBy(*keys, "_bucket").orderBy("position")
    so_far = inside.rowsBetween(W.unboundedPreceding, -1)
    number = F.col("entry_number")
    rows = rows.withColumn("_before", F.last("entry_number", ignorenulls=True).over(so_far))
    changes = number.isNotNull() & F.col("_before").isNotNull() & (number != F.col("_before"))
    first_here = number.isNotNull() & F.col("_before").isNull()
    rows = rows.withColumn("_inner_start", F.when(changes, F.col("position")))
    rows = rows.withColumn("_first_position", F.when(first_here, F.col("position")))

    summary = rows.groupBy(*keys, "_bucket").agg(
        F.max("_first_position").alias("_first_position"),
        F.max(F.when(first_here, number)).alias("_first_number"),
        F.max_by("entry_number", F.when(number.isNotNull(), F.col("position"))).alias("_last_number"),
        F.max("_inner_start").alias("_last_inner_start"),
    )
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    summary = summary.withColumn("_carried_number", F.last("_last_number", ignorenulls=True).over(earlier))
    opens = F.col("_carried_number").isNull() | (F.col("_carried_number") != F.col("_first_number"))
    summary = summary.withColumn("_opening", F.when(opens, F.col("_first_position")))
    summary = summary.withColumn("_last_start", F.coalesce("_last_inner_start", "_opening"))
    summary = summary.withColumn("_carried_start", F.last("_last_start", ignorenulls=True).over(earlier))
    borders = summary.select(*keys, "_bucket", "_opening", "_carried_number", "_carried_start")

    joined = rows.join(borders, [*keys, "_bucket"])
    start = F.coalesce(F.col("_inner_start"), F.when(F.col("position") == F.col("_opening"), F.col("position")))
    through = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = joined.withColumn("_start", start)
    return (
        joined.withColumn("entry_start", F.coalesce(F.last("_start", ignorenulls=True).over(through), "_carried_start"))
        .withColumn("entry_number", F.coalesce(number, "_before", "_carried_number"))
        .filter(F.col("entry_start").isNotNull())
        .drop("_bucket", "_before", "_inner_start", "_first_position", "_opening", "_carried_number", "_carried_start", "_start")
    )


def entries_and_lines(assembled: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entry headers taken from the first line, and the lines that name an account."""
    keys = ["source_id"] if keys is None else keys
    header = assembled.filter(F.col("position") == F.col("entry_start"))
    entries = header.select(*keys, "entry_start", "entry_number", "registration_date", "description")
    lines = assembled.filter(strip(F.coalesce("account", F.lit(""))) != "")
    return entries, lines.select(*keys, "entry_start", "entry_number", "position", "account", "debit", "credit")


def entry_totals(lines: DataFrame) -> DataFrame:
    """Totals per entry that has lines."""
    totals = lines.groupBy(*ENTRY_KEY).agg(
        F.sum("debit").alias("total_debit"), F.sum("credit").alias("total_credit"), F.count(F.lit(1)).alias("line_count")
    )
    return _derived_totals(totals)


def _derived_totals(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "difference": F.col("total_debit") - F.col("total_credit"),
            "balanced": F.col("total_debit") == F.col("total_credit"),
            "amount": F.greatest("total_debit", "total_credit"),
        }
    )


def with_totals(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries with their totals; an entry without lines has zero totals and no lines."""
    totals = entry_totals(lines).select(*ENTRY_KEY, "total_debit", "total_credit", "line_count")
    joined = entries.join(totals, ENTRY_KEY, "left")
    zero = F.lit(0)
    return _derived_totals(
        joined.withColumns(
            {
                "total_debit": F.coalesce("total_debit", zero.cast(totals.schema["total_debit"].dataType)),
                "total_credit": F.coalesce("total_credit", zero.cast(totals.schema["total_credit"].dataType)),
                "line_count": F.coalesce("line_count", zero),
            }
        )
    )


def anomaly_cell(kind: str, severity: str, description: Column, **details: Column) -> Column:
    """One finding on the row at hand, as a struct of the columns that follow the entry's keys."""
    pairs = [x for name, value in details.items() for x in (F.lit(name), value.cast("string"))]
    return F.struct(
        F.lit(kind).alias("anomaly_type"),
        F.lit(severity).alias("severity"),
        description.alias("description"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("details"),
    )


def _findings(df: DataFrame) -> DataFrame:
    """Rows with a finding in ``_found`` as anomalies."""
    return df.select("engagement_id", "_found.anomaly_type", "_found.severity", "entry_id", "entry_number", "_found.description", "_found.details")


def anomaly(df: DataFrame, kind: str, severity: str, description: Column, **details: Column) -> DataFrame:
    return _findings(df.withColumn("_found", anomaly_cell(kind, severity, description, **details)))


def _say(template: str, **values: Column) -> Column:
    """Text with {name} placeholders filled from columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _unbalanced() -> Column:
    c = F.col
    text = _say(
        "Registrazione n. {n} sbilanciata: Dare={d}, Avere={a}, Differenza={x}",
        n=c("entry_number"), d=c("total_debit"), a=c("total_credit"), x=F.abs("difference"),
    )
    cell = anomaly_cell("unbalanced", "critical", text, debit=c("total_debit"), credit=c("total_credit"), difference=c("difference"))
    return F.when(c("difference") != 0, cell)


def _undescribed() -> Column:
    text = _say("Registrazione n. {n} senza causale/descrizione", n=F.col("entry_number"))
    return F.when(_no_description(), anomaly_cell("missing_description", "info", text))


def _thin() -> Column:
    text = _say("Registrazione n. {n} con meno di 2 righe (trovate: {k})", n=F.col("entry_number"), k=F.col("line_count"))
    return F.when(F.col("line_count") < 2, anomaly_cell("other", "warning", text, line_count=F.col("line_count")))


def _on_weekend() -> Column:
    day = F.weekday("registration_date")
    name = F.when(day == 5, "Sabato").otherwise("Domenica")
    text = _say("Registrazione n. {n} in {w} ({d})", n=F.col("entry_number"), w=name, d=F.col("registration_date"))
    return F.when(day >= 5, anomaly_cell("weekend_entry", "info", text, date=F.col("registration_date"), weekday=day, day_name=name))


def _checked(df: DataFrame, *checks: Column) -> DataFrame:
    """Findings of several checks of single rows, in one pass over them."""
    return _findings(df.withColumn("_found", F.explode(F.array_compact(F.array(*checks)))))


def entry_findings(totalled: DataFrame) -> DataFrame:
    """Unbalanced entries, entries without description or with fewer than two lines, and entries on a weekend."""
    return _checked(totalled, _unbalanced(), _undescribed(), _thin(), _on_weekend())


def unbalanced_entries(totalled: DataFrame) -> DataFrame:
    return _checked(totalled, _unbalanced())


def missing_description(entries: DataFrame) -> DataFrame:
    return _checked(entries, _undescribed())


def too_few_lines(totalled: DataFrame) -> DataFrame:
    return _checked(totalled, _thin())


def weekend_entries(entries: DataFrame) -> DataFrame:
    return _checked(entries, _on_weekend())


def date_regression(entries: DataFrame) -> DataFrame:
    """Entries dated before the entry that precedes them in load order."""
    levelled = entries.withColumn("_level", number_bucket("load_order"))
    payload = ["entry_id", "entry_number", "registration_date"]
    back = F.col("next_registration_date") < F.col("registration_date")
    rows = neighbours(levelled, ["engagement_id"], ["_level"], ["load_order"], payload, back).select(
        "engagement_id", *[F.col(f"next_{c}").alias(c) for c in payload], F.col("registration_date").alias("previous_date"))
    c = F.col
    text = _say(
        "Registrazione n. {n} con data anteriore alla precedente: {d} < {p}",
        n=c("entry_number"), d=c("registration_date"), p=c("previous_date"),
    )
    return anomaly(
        rows, "invalid_date", "warning", text, entry_date=c("registration_date"), previous_date=c("previous_date")
    )


def _lines_outside_chart(lines: DataFrame, chart: DataFrame) -> DataFrame:
    named = lines.filter(F.coalesce("account", F.lit("")) != "")
    return named.join(chart.select("account").distinct(), "account", "left_anti")


def unknown_accounts(lines: DataFrame, chart: DataFrame | None) -> DataFrame:
    """One warning per line on an account that the chart of accounts lacks."""
    return _unknown(lines.limit(0) if chart is None else _lines_outside_chart(lines, chart))


def _unknown(rows: DataFrame) -> DataFrame:
    text = _say(
        "Registrazione n. {n}: codice conto '{a}' non trovato nel piano dei conti",
        n=F.col("entry_number"), a=F.col("account"),
    )
    return anomaly(rows, "missing_account", "warning", text, account_code=F.col("account"))


def _no_description() -> Column:
    return strip(F.coalesce("description", F.lit(""))) == ""


def entry_number_gaps(entries: DataFrame, listed: int | None = None) -> DataFrame:
    """A warning per gap in entry numbers, on the first entry after it.

    The gap is told by the numbers at its ends and its size; with ``listed`` the first missing numbers are listed too.
    """
    first = entries.groupBy("engagement_id", "entry_number").agg(F.min("load_order").alias("load_order"))
    levelled = first.withColumns(
        {"_far": number_bucket("entry_number", 10**12), "_near": number_bucket("entry_number")}
    )
    apart = F.col("next_entry_number") - F.col("entry_number") > 1
    gaps = neighbours(levelled, ["engagement_id"], ["_far", "_near"], ["entry_number"], ["load_order"], apart).select(
        "engagement_id", F.col("next_entry_number").alias("entry_number"), F.col("next_load_order").alias("load_order"),
        F.col("entry_number").alias("previous_number"))
    named = gaps.join(entries.select("engagement_id", "load_order", "entry_id"), ["engagement_id", "load_order"])
    c = F.col
    count = c("entry_number") - c("previous_number") - 1
    text = _say(
        "Buco nella numerazione: da {p} a {n}, mancano {k} registrazioni",
        p=c("previous_number"), n=c("entry_number"), k=count,
    )
    details = {"previous_number": c("previous_number"), "current_number": c("entry_number"), "missing_count": count}
    if listed is not None:
        shown = F.sequence(c("previous_number") + 1, F.least(c("entry_number") - 1, c("previous_number") + listed))
        details["missing_numbers"] = F.array_join(shown.cast("array<string>"), ",")
    return anomaly(named, "sequence_gap", "warning", text, **details)


def duplicate_entries(lines: DataFrame) -> DataFrame:
    """Entries after the first with the same date, first account and amount, from laid-out lines.

    The first of each group is an aggregate that combines on the map side, so a large group of
    copies is never gathered; only groups with copies are joined back.
    """
    signature = ["engagement_id", "registration_date", "first_account", "amount"]
    signed = lines.filter("first_line").select(
        *[F.col("account").alias(c) if c == "first_account" else c for c in signature], "entry_id", "entry_number", "load_order")
    groups = signed.groupBy(*signature).agg(F.min("load_order").alias("first_order"), F.count(F.lit(1)).alias("copies"))
    several = signed.join(groups.filter("copies > 1").drop("copies"), signature)
    originals = several.filter(F.col("load_order") == F.col("first_order")).select(
        "engagement_id", F.col("load_order").alias("first_order"), F.col("entry_number").alias("original_number"))
    later = several.filter(F.col("load_order") > F.col("first_order")).join(originals, ["engagement_id", "first_order"])
    text = _say(
        "Possibile duplicato della registrazione n. {o}: stessa data, conto e importo", o=F.col("original_number")
    )
    return anomaly(
        later, "duplicate", "warning", text, original_number=F.col("original_number"),
        signature=F.concat_ws("|", "registration_date", "first_account", "amount"),
    )


def validate_entries(
    totalled: DataFrame, lines: DataFrame, chart: DataFrame | None = None, order: str = "registration_date"
) -> DataFrame:
    """Per entry the names of passed and failed checks and the valid flag.

    ``order`` is what entries are compared in for the date check: ``registration_date`` (each entry
    then follows an earlier date, so only the first has no check) or ``load_order``.
    """
    days = totalled.groupBy("engagement_id", "registration_date").agg(F.min("load_order").alias("load_order"))
    first = F.min("load_order") if order == "load_order" else F.min_by("load_order", F.struct("registration_date", "load_order"))
    firsts = days.groupBy("engagement_id").agg(first.alias("load_order")).withColumn("_first", F.lit(True))
    marked = totalled.join(firsts, ["engagement_id", "load_order"], "left")
    if order == "load_order":
        back = date_regression(totalled).select(*ENTRY_KEY).distinct().withColumn("_back", F.lit(True))
        marked = marked.join(back, ENTRY_KEY, "left")
    else:
        marked = marked.withColumn("_back", F.lit(None).cast("boolean"))
    checks = [
        ("bilanciamento", F.lit(True), F.col("difference") != 0),
        ("sequenza_date", F.col("_first").isNull(), F.coalesce("_back", F.lit(False))),
    ]
    if chart is not None:
        outside = _lines_outside_chart(lines, chart).select(*ENTRY_KEY).distinct().withColumn("_outside", F.lit(True))
        marked = marked.join(outside, ENTRY_KEY, "left")
        checks.append(("codici_conto", F.lit(True), F.coalesce("_outside", F.lit(False))))
    checks.append(("completezza", F.lit(True), _no_description() | (F.col("line_count") < 2)))
    checks.append(("weekend", F.lit(True), F.lit(False)))
    failed = F.array_compact(F.array(*[F.when(ran & bad, name) for name, ran, bad in checks]))
    passed = F.array_compact(F.array(*[F.when(ran & ~bad, name) for name, ran, bad in checks]))
    return marked.select(
        *ENTRY_KEY, "entry_number", passed.alias("checks_passed"), failed.alias("checks_failed"),
        (F.size(failed) == 0).alias("is_valid"),
    )
