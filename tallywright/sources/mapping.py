"""Explicit mapping of raw columns to the canonical journal row, its checks and its rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywright.functions.parsing import MONEY, PRECISE, amount_strict, date_strict, text_or_null, time_strict

JOURNAL_FIELDS = [
    "effective_date", "created_date", "created_seconds", "entry_id", "document_number", "net_amount",
    "description", "user_name", "account",
]
MAPPABLE_FIELDS = [*JOURNAL_FIELDS, "debit", "credit"]
REQUIRED_FIELDS = ["entry_id", "effective_date"]
AMOUNT_FIELDS = ["net_amount", "debit", "credit"]
MANDATORY = ["effective_date", "entry_id", "net_amount"]


def map_journal(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Canonical journal columns next to the raw lineage columns, plus ``rejected`` field names.

    With a debit or credit column mapped, net is debit minus credit and a blank counts as zero;
    otherwise the signed net column is taken. A cell that is filled but unreadable, a mandatory field
    that is missing and an amount with more than two decimals put the field in ``rejected``.
    """
    unknown = sorted(set(mapping) - set(MAPPABLE_FIELDS))
    if unknown:
        raise ValueError(f"unknown journal fields: {', '.join(unknown)}")

    def cell(field: str):
        return F.col(f"`{mapping[field]}`").cast("string") if field in mapping else F.lit(None).cast("string")

    parsers = {"effective_date": date_strict, "created_date": date_strict, "created_seconds": time_strict}
    values = {f: parsers.get(f, text_or_null)(cell(f)) for f in JOURNAL_FIELDS if f != "net_amount"}
    sided = "debit" in mapping or "credit" in mapping
    amounts = ["debit", "credit"] if sided else ["net_amount"]
    parsed = {f: amount_strict(cell(f)) for f in amounts}
    zero = F.lit(0).cast(PRECISE)
    if sided:
        net = F.coalesce(parsed["debit"], zero) - F.coalesce(parsed["credit"], zero)
    else:
        net = parsed["net_amount"]
    values["net_amount"] = net.try_cast(MONEY)

    problems = []
    for field in JOURNAL_FIELDS:
        bad = F.lit(False)
        if field in parsers:
            bad = text_or_null(cell(field)).isNotNull() & values[field].isNull()
        if field == "net_amount":
            for f in amounts:
                bad = bad | (text_or_null(cell(f)).isNotNull() & parsed[f].isNull())
            bad = bad | F.coalesce(values[field] != net, F.lit(False))
        if field in MANDATORY:
            bad = bad | values[field].isNull()
        problems.append(F.when(bad, field))
    lineage = [c for c in raw.columns if c not in set(mapping.values()) and c not in values]
    return raw.select(
        *[F.col(f"`{c}`") for c in lineage],
        *[values[f].alias(f) for f in JOURNAL_FIELDS],
        F.array_compact(F.array(*problems)).alias("rejected"),
    )


def accepted_rows(mapped: DataFrame, strict: bool = False) -> DataFrame:
    """Rows that can be staged; in strict mode the first rejected row aborts the job."""
    if strict:
        message = F.concat(F.lit("row not importable: "), F.array_join("rejected", ", "))
        # In the projection, not in a filter: filters may be reordered before those of the source.
        checked = F.when(F.size("rejected") > 0, F.raise_error(message).cast("string")).otherwise(F.col("entry_id"))
        return mapped.withColumn("entry_id", checked).drop("rejected")
    return mapped.filter(F.size("rejected") == 0).drop("rejected")


def reject_rows(mapped: DataFrame) -> DataFrame:
    return mapped.filter(F.size("rejected") > 0)


def validate_mapping(mappings: DataFrame, headers: DataFrame) -> DataFrame:
    """(mapping_id, violation, item) for mappings given as (mapping_id, field, column_name)."""
    unknown_columns = (
        mappings.select("mapping_id", F.col("column_name").alias("item"))
        .distinct()
        .join(headers.select("mapping_id", F.col("header").alias("item")), ["mapping_id", "item"], "left_anti")
        .select("mapping_id", F.lit("unknown_column").alias("violation"), "item")
    )
    return unknown_columns.unionByName(_field_violations(mappings))


def _field_violations(mappings: DataFrame) -> DataFrame:
    field = F.col("field")
    unknown = (
        mappings.filter(~field.isin(MAPPABLE_FIELDS)).select(
            "mapping_id", F.lit("unknown_field").alias("violation"), field.alias("item")).distinct()
    )
    has = [F.bool_or(field == name).alias(f"has_{name}") for name in REQUIRED_FIELDS]
    per_mapping = mappings.groupBy("mapping_id").agg(*has, F.bool_or(field.isin(AMOUNT_FIELDS)).alias("has_amount"))
    lacking = F.array_compact(
        F.array(
            *[F.when(~F.col(f"has_{name}"), name) for name in REQUIRED_FIELDS],
            F.when(~F.col("has_amount"), "net_amount"),
        )
    )
    missing = per_mapping.select("mapping_id", F.lit("missing_field").alias("violation"), F.explode(lacking).alias("item"))
    return unknown.unionByName(missing)


def validate_profile(positions: DataFrame) -> DataFrame:
    """Violations of profiles given as (mapping_id, field, start, end)."""
    ranges = positions.filter((F.col("start") < 0) | (F.col("end") <= F.col("start"))).select(
        "mapping_id", F.lit("bad_range").alias("violation"), F.col("field").alias("item")
    )
    return ranges.unionByName(_field_violations(positions))
