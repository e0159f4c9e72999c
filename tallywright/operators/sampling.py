"""Repeatable audit samples. Every function works on entries that carry their totals."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallywright.operators.entries import ENTRY_KEY

REASONS = ["threshold", "focus_account", "unbalanced", "round_amount", "random"]
#: Characters of a digest by which entries are counted.
PREFIX = 4


def sample_by_threshold(totalled: DataFrame, threshold: Decimal) -> DataFrame:
    return totalled.filter(F.col("amount") >= F.lit(threshold))


def _focus_entries(lines: DataFrame, accounts: list[str]) -> DataFrame:
    wanted = [account.lower() for account in accounts]
    return lines.filter(F.lower("account").isin(wanted)).select(*ENTRY_KEY).distinct()


def sample_by_accounts(totalled: DataFrame, lines: DataFrame, accounts: list[str]) -> DataFrame:
    return totalled.join(_focus_entries(lines, accounts), ENTRY_KEY, "left_semi")


def sample_unbalanced(totalled: DataFrame) -> DataFrame:
    return totalled.filter(~F.col("balanced"))


def _is_round(unit: int) -> Column:
    return (F.col("amount") >= unit) & (F.col("amount") % unit == 0)


def sample_round_amounts(totalled: DataFrame, unit: int = 1000) -> DataFrame:
    return totalled.filter(_is_round(unit))


def sample_random(totalled: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` entries per engagement without replacement; same seed, same sample, any partitioning.

    Entries are ordered by a digest of seed and id. Counts of the digests' first characters tell where the nth entry
    lies: entries before that prefix are drawn as they are, those behind it are not, and only the entries that share the
    prefix (one in 65,536) are ranked.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("entry_id")))
    marked = totalled.withColumn("_digest", digest).withColumn("_prefix", F.left("_digest", F.lit(PREFIX)))
    counts = marked.groupBy("engagement_id", "_prefix").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("engagement_id").orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    borders = counts.filter((F.col("_before") < n) & (F.col("_before") + F.col("_rows") >= n)).select(
        F.col("engagement_id").alias("_key"), F.col("_prefix").alias("_border"), (F.lit(n) - F.col("_before")).alias("_left"))
    near = marked.join(borders, F.col("engagement_id").eqNullSafe(F.col("_key")), "left").filter(
        F.col("_border").isNull() | (F.col("_prefix") <= F.col("_border")))
    place = F.row_number().over(W.partitionBy("engagement_id", "_prefix").orderBy("_digest", "entry_id"))
    drawn = near.withColumn("_place", place).filter(
        F.lit(n > 0) & (F.col("_border").isNull() | (F.col("_prefix") < F.col("_border")) | (F.col("_place") <= F.col("_left"))))
    return drawn.select(*totalled.columns)


def combined_sample(
    totalled: DataFrame,
    lines: DataFrame,
    threshold: Decimal | None = None,
    focus_accounts: list[str] | None = None,
    include_unbalanced: bool = True,
    include_round_amounts: bool = False,
    random_count: int = 25,
    seed: int = 0,
    date_from: date | None = None,
    date_to: date | None = None,
) -> DataFrame:
    """Each entry once, with the first reason that selects it; random draws come from the rest."""
    pool = totalled
    if date_from is not None:
        pool = pool.filter(F.col("registration_date") >= F.lit(date_from))
    if date_to is not None:
        pool = pool.filter(F.col("registration_date") <= F.lit(date_to))
    never = F.lit(False)
    focus = never
    if focus_accounts:
        hits = _focus_entries(lines, focus_accounts).withColumn("_focus", F.lit(True))
        pool = pool.join(hits, ENTRY_KEY, "left")
        focus = F.coalesce("_focus", never)
    reason = (
        F.when(never if threshold is None else F.col("amount") >= F.lit(threshold), REASONS[0])
        .when(focus, REASONS[1])
        .when(F.lit(include_unbalanced) & ~F.col("balanced"), REASONS[2])
        .when(F.lit(include_round_amounts) & _is_round(1000), REASONS[3])
    )
    marked = pool.withColumn("sample_reason", reason).drop("_focus")
    chosen = marked.filter(F.col("sample_reason").isNotNull())
    if random_count == 0:
        return chosen
    drawn = sample_random(marked.filter(F.col("sample_reason").isNull()), random_count, seed)
    return chosen.unionByName(drawn.withColumn("sample_reason", F.lit(REASONS[4])))


def sample_stats(sample: DataFrame, entries: DataFrame) -> DataFrame:
    """Population, sample size, percentage and sampled amount per engagement."""
    population = entries.groupBy("engagement_id").agg(F.count(F.lit(1)).alias("total_entries"))
    drawn = sample.groupBy("engagement_id").agg(
        F.count(F.lit(1)).alias("sample_size"), F.sum("amount").alias("total_amount_sampled")
    )
    joined = population.join(drawn, "engagement_id", "left")
    size = F.coalesce("sample_size", F.lit(0))
    return joined.select(
        "engagement_id",
        "total_entries",
        size.alias("sample_size"),
        (size * 100 / F.col("total_entries")).cast("decimal(9,4)").alias("sample_percentage"),
        F.coalesce("total_amount_sampled", F.lit(0).cast("decimal(38,2)")).alias("total_amount_sampled"),
    )
