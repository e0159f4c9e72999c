"""Neighbour, numbering and running-value operations that never put a whole key in one task.

A plain ``lead() over (partition by engagement ...)`` sends an engagement to a single task. Here
rows are first handled inside buckets that cut a key's ordered rows into bounded runs; afterwards
only one summary row per bucket is ordered across buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET_ROWS = 1_000_000


def number_bucket(column: Column | str, width: int = BUCKET_ROWS) -> Column:
    """Lower bound of the bucket a whole number falls in (exact for decimals too)."""
    number = F.col(column) if isinstance(column, str) else column
    return number - F.pmod(number, F.lit(width))


def neighbours(
    df: DataFrame, keys: list[str], levels: list[str], order: list[str], payload: list[str], hit: Column | None = None
) -> DataFrame:
    """Every row with the row that follows it in ``order`` inside ``keys``, as columns ``next_<name>``; rows without a follower go.

    ``order`` sorts the rows of a key completely. ``levels`` are columns, coarse to fine, that follow it: all rows of
    an earlier bucket come before all rows of a later one. ``hit`` (over the columns and their ``next_`` ones) says
    which pairs are wanted.

    The input is read once. In the finest buckets every row gets its follower, and only wanted pairs and the border
    rows of each bucket (first and last) go on. Of these, the border rows meet those of the other buckets of the next
    level, where the last row of a bucket gets the first of the next one; wanted pairs inside stay spread by bucket.
    """
    columns = list(dict.fromkeys([*order, *payload]))
    wanted = F.coalesce(hit, F.lit(False)) if hit is not None else F.lit(True)
    rows = df.select(*keys, *levels, *columns)
    inside = W.partitionBy(*keys, *levels).orderBy(*order)
    follower = {f"next_{c}": F.lead(c).over(inside) for c in columns}
    rows = rows.withColumns(follower | {"_first": F.row_number().over(inside) == 1, "_last": F.lead(F.lit(True)).over(inside).isNull()})
    for depth in range(len(levels) - 1, -1, -1):
        rows = rows.filter((wanted & ~F.col("_last")) | F.col("_first") | F.col("_last"))
        border = F.col("_first") | F.col("_last")
        rows = rows.withColumn("_spread", F.when(~border, F.xxhash64(*keys, *levels)))
        across = W.partitionBy(*keys, *levels[:depth], "_spread").orderBy(*order)
        found = {f"_{c}": F.lead(c).over(across) for c in columns}
        rows = rows.withColumns(found | {"_top": F.row_number().over(across) == 1, "_end": F.lead(F.lit(True)).over(across).isNull()})
        linked = {f"next_{c}": F.when(F.col("_last"), F.col(f"_{c}")).otherwise(F.col(f"next_{c}")) for c in columns}
        rows = rows.withColumns(linked | {"_first": border & F.col("_top"), "_last": F.col("_last") & F.col("_end")})
        rows = rows.drop("_spread", "_top", "_end", *found)
    return rows.filter(wanted & ~F.col("_last")).drop("_first", "_last", *levels)


def number_rows(df: DataFrame, keys: list[str], bucket: list[str], order: list[str], name: str) -> DataFrame:
    """Add a 1-based row number per key; ``bucket`` columns follow ``order`` and bound the work."""
    inside = W.partitionBy(*keys, *bucket).orderBy(*order)
    before = W.partitionBy(*keys).orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        df.groupBy(*keys, *bucket)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(sizes, [*keys, *bucket])
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("bigint"))
        .drop("_inside", "_offset")
    )


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """The first ``n`` rows per key. The planner keeps at most ``n`` rows per key and map task."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
