"""Numbering and hashing of staged rows, union of active sources, removal of identical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tallywright.functions.ordered import number_bucket, number_rows
from tallywright.functions.tables import broadcast_if_small
from tallywright.sources.mapping import JOURNAL_FIELDS

ROWS_PER_SOURCE = 10**12


def row_hash():
    canonical = F.to_json(F.struct(*JOURNAL_FIELDS), {"ignoreNullFields": "false"})
    return F.sha2(canonical, 256)


def stage_rows(rows: DataFrame, position: str = "line_number") -> DataFrame:
    """Number rows from 1 within their source in line order and hash each canonical row."""
    bucketed = rows.withColumn("_bucket", number_bucket(position))
    numbered = number_rows(bucketed, ["source_id"], ["_bucket"], [position], "row_number")
    return numbered.withColumn("row_hash", row_hash()).drop("_bucket")


def union_active_sources(staged: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of sources that are active and ready, with a load order: creation, source, row number."""
    usable = sources.filter(F.col("active") & (F.col("state") == "pronta"))
    order = W.partitionBy("engagement_id").orderBy("created_at", "source_id")
    ranked = usable.withColumn("_rank", F.row_number().over(order)).select("engagement_id", "source_id", "_rank")
    joined = staged.join(broadcast_if_small(ranked, bound=sources), "source_id")
    return joined.withColumn("load_order", F.col("_rank") * F.lit(ROWS_PER_SOURCE) + F.col("row_number")).drop("_rank")


def drop_identical_rows(rows: DataFrame, strategy: str = "scarta_identiche") -> DataFrame:
    """Keep the first row in load order per engagement and hash, or everything with ``mantieni_tutti``.

    The first row is an aggregate that combines before the shuffle, so a row copied millions of times
    costs one row per map task.
    """
    if strategy == "mantieni_tutti":
        return rows
    if strategy != "scarta_identiche":
        raise ValueError(f"unknown duplicate strategy {strategy!r}")
    rest = [c for c in rows.columns if c not in ("engagement_id", "row_hash")]
    first = F.min_by(F.struct(*rest), "load_order").alias("r")
    return rows.groupBy("engagement_id", "row_hash").agg(first).select("engagement_id", "row_hash", "r.*")
