"""Completeness of document numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywright.functions.ordered import neighbours
from tallywright.functions.parsing import strip

NUMBER = "decimal(38,0)"
#: Numbers of at most so many digits are added and subtracted as decimals, longer ones in pieces of 18 digits.
DECIMAL_DIGITS, PIECE = 38, 18
#: Numbers that agree in all but so many digits lie in one range.
RANGE_DIGITS = (18, 12, 6)
DEFAULT_MAX_GAP = 10_000


def _significant(number: str) -> Column:
    """Digits of an all-digit number without leading zeros, else NULL."""
    text = strip(F.col(number))
    return F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=.)", ""))


def _pieces(digits: Column, count: Column) -> Column:
    """A number as ``count`` whole numbers of 18 digits each, lowest first."""
    padded = F.lpad(digits, count * PIECE, "0")
    return F.transform(F.sequence(count, F.lit(1), F.lit(-1)), lambda i: F.substring(padded, (i - 1) * PIECE + 1, F.lit(PIECE)).cast("bigint"))


def _combined(a: Column, b: Column, sign: int) -> Column:
    """``a + sign * b`` of numbers given as digits, as digits; ``a`` is at least ``b``. Digits are carried from piece to piece."""
    count = F.ceil((F.greatest(F.length(a), F.length(b)) + 1) / PIECE).cast("int")
    pairs = F.zip_with(_pieces(a, count), _pieces(b, count), lambda x, y: x + sign * y)
    base = 10**PIECE
    empty = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("text"))

    def add(state: Column, piece: Column) -> Column:
        value = piece + state["carry"]
        digits = F.lpad(F.pmod(value, F.lit(base)).cast("string"), PIECE, "0")
        return F.struct(F.floor(value / F.lit(base).cast("decimal(19,0)")).cast("bigint").alias("carry"), F.concat(digits, state["text"]).alias("text"))

    return F.regexp_replace(F.aggregate(pairs, empty, add)["text"], "^0+(?=.)", "")


def _plus(digits: Column, small: Column) -> Column:
    """A number of any length and a small whole number, added."""
    short = (digits.try_cast(NUMBER) + small).cast(NUMBER).cast("string")
    return F.when(F.length(digits) < DECIMAL_DIGITS, short).otherwise(_combined(digits, small.cast("string"), 1))


def numbering_gaps(rows: DataFrame, number: str = "document_number") -> DataFrame:
    """(engagement, previous, following, missing), digits each, for every gap between all-digit numbers of any length.

    Copies collapse before any ordering; the distinct numbers are compared as text of equal length, inside ranges of a
    million and then range by range, so no engagement is sorted in one task.
    """
    numbers = rows.select("engagement_id", _significant(number).alias("digits")).filter("digits IS NOT NULL").distinct()
    size = F.length("digits")
    ranges = {f"_r{n}": F.concat(size.cast("string"), F.lit(":"), F.substring(F.col("digits"), F.lit(1), F.greatest(size - n, F.lit(0)))) for n in RANGE_DIGITS}
    levelled = numbers.withColumns({"size": size} | ranges)
    apart = F.when(F.col("next_size") <= DECIMAL_DIGITS, F.col("next_digits").try_cast(NUMBER) - F.col("digits").try_cast(NUMBER) > 1).otherwise(
        F.col("next_digits") != _combined(F.col("digits"), F.lit("1"), 1))
    pairs = neighbours(levelled, ["engagement_id"], list(ranges), ["size", "digits"], [], apart)
    between = (F.col("next_digits").try_cast(NUMBER) - F.col("digits").try_cast(NUMBER) - 1).cast(NUMBER).cast("string")
    missing = F.when(F.col("next_size") <= DECIMAL_DIGITS, between).otherwise(
        _combined(_combined(F.col("next_digits"), F.col("digits"), -1), F.lit("1"), -1))
    return pairs.select("engagement_id", F.col("digits").alias("previous"), F.col("next_digits").alias("following"), missing.alias("missing"))


def _at_most(missing: Column, most: int) -> Column:
    return (F.length(missing) <= PIECE) & (missing.try_cast("bigint") <= most)


def _check(max_gap: int) -> None:
    if max_gap < 0:
        raise ValueError("max_gap must not be negative")


def sequence_missing(rows: DataFrame, max_gap: int = DEFAULT_MAX_GAP) -> DataFrame:
    """One row per missing number in gaps of at most ``max_gap`` numbers."""
    _check(max_gap)
    narrow = numbering_gaps(rows).filter(_at_most(F.col("missing"), max_gap))
    offsets = F.explode(F.sequence(F.lit(1), F.col("missing").cast("int"))).alias("offset")
    return narrow.select("engagement_id", "previous", offsets).select(
        "engagement_id",
        _plus(F.col("previous"), F.col("offset")).alias("expected_number"),
        F.lit(None).cast("string").alias("found_number"),
        F.lit(True).alias("is_missing"),
    )


def sequence_wide_gaps(rows: DataFrame, max_gap: int = DEFAULT_MAX_GAP) -> DataFrame:
    """Gaps of more than ``max_gap`` numbers as intervals that are not listed one by one."""
    _check(max_gap)
    wide = numbering_gaps(rows).filter(~_at_most(F.col("missing"), max_gap))
    return wide.select(
        "engagement_id",
        F.col("previous").alias("previous_number"),
        F.col("following").alias("next_number"),
        F.col("missing").alias("missing_count"),
    )
