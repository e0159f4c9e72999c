"""Counts, status, report tables and evidence of an entry-level run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywright.functions.ordered import first_n
from tallywright.operators.entries import ENTRY_KEY, _say
from tallywright.operators.sampling import REASONS


def severity_counts(validations: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per engagement: validated entries, entries with issues, critical and warning anomalies."""
    checked = validations.groupBy("engagement_id").agg(
        F.count(F.lit(1)).alias("entries_validated"), F.count_if(~F.col("is_valid")).alias("entries_with_issues")
    )
    found = anomalies.groupBy("engagement_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical_anomalies"),
        F.count_if(F.col("severity") == "warning").alias("warning_anomalies"),
    )
    counts = ["entries_validated", "entries_with_issues", "critical_anomalies", "warning_anomalies"]
    return checked.join(found, "engagement_id", "full").fillna(0, counts).select("engagement_id", *counts)


def run_status(counts: DataFrame) -> DataFrame:
    c = F.col
    v, k, w = c("entries_validated"), c("critical_anomalies"), c("warning_anomalies")
    status = F.when((v == 0) | (k > 0), "wip").otherwise("✓")
    reasoning = (
        F.when(v == 0, "Nessuna registrazione analizzata - in attesa del libro giornale")
        .when(k > 0, _say(
            "Rilevate {k} anomalie critiche su {v} registrazioni campionate - richiede revisione", k=k, v=v))
        .when(w > 0, _say(
            "Test completato su {v} registrazioni. {w} note di attenzione, nessuna anomalia critica.", v=v, w=w))
        .otherwise(_say("Test completato su {v} registrazioni. Nessuna anomalia rilevata.", v=v))
    )
    return counts.withColumns({"status": status, "reasoning": reasoning})


def report_anomalies(anomalies: DataFrame, shown_notes: int | None = None) -> DataFrame:
    """All critical and warning anomalies and the notes of each engagement, only the first ones where a number is given."""
    columns = ["engagement_id", "severity", "entry_number", "anomaly_type", "description"]
    flat = anomalies.select(*columns)
    if shown_notes is None:
        return flat
    notes = first_n(
        flat.filter(F.col("severity") == "info"), ["engagement_id"],
        [F.col("entry_number"), F.col("anomaly_type"), F.col("description")], shown_notes,
    ).drop("rank_no")
    return flat.filter(F.col("severity") != "info").unionByName(notes)


def report_sample(sample: DataFrame, validations: DataFrame, shown: int | None = None, text_width: int | None = None) -> DataFrame:
    """Sampled entries with their totals and validity, and with ``shown`` only the first of each engagement.

    ``position`` is their place in the report (by reason and load order). It is a rank, so it is only given with ``shown``;
    without it the rows carry reason and load order instead, and nothing is ranked. ``text_width`` cuts descriptions.
    """
    reason = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("sample_reason"))
    if shown is None:
        first, place = sample, [F.col("sample_reason"), F.col("load_order")]
    else:
        first = first_n(sample, ["engagement_id"], [reason, F.col("load_order")], shown)
        place = [F.col("rank_no").alias("position")]
    valid = validations.select(*ENTRY_KEY, "is_valid")
    text = F.col("description") if text_width is None else F.left("description", F.lit(text_width)).alias("description")
    return first.join(valid, ENTRY_KEY, "left").select(
        "engagement_id", *place, "entry_number", "registration_date", text, "total_debit", "total_credit",
        F.when(F.col("is_valid"), "✓").otherwise("⚠").alias("outcome"),
    )


def result_as_evidence(status: DataFrame, stats: DataFrame, source_path: str) -> DataFrame:
    """One evidence row per engagement on the journal item, with the run's figures as fields."""
    run = stats.join(status, "engagement_id", "left").fillna(
        0, ["entries_validated", "critical_anomalies", "warning_anomalies"]
    )
    found = F.col("entries_validated") > 0
    figures = [
        ("jet_entries_total", "total_entries"),
        ("jet_entries_sampled", "sample_size"),
        ("jet_critical_anomalies", "critical_anomalies"),
        ("jet_warning_anomalies", "warning_anomalies"),
    ]
    fields = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"), F.col(name).cast("string").alias("value"), F.lit(None).cast("string").alias("unit")
            )
            for kind, name in figures
        ]
    )
    return run.select(
        "engagement_id",
        F.lit("D.1").alias("item_id"),
        found.alias("found"),
        F.when(found, F.lit(source_path)).alias("source_path"),
        F.lit("Libro giornale").alias("source_name"),
        fields.alias("fields"),
        F.lit("jet_analysis").alias("method"),
        F.when(found, F.lit("0.9")).otherwise(F.lit("0.0")).cast("decimal(3,2)").alias("confidence"),
        _say("Campionate {s} registrazioni su {t}", s=F.col("sample_size"), t=F.col("total_entries")).alias("excerpt"),
        F.col("reasoning").alias("notes"),
    )
