"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallywright.functions.tables import planned_bytes, session_bytes, shared_folder, stored

__all__ = ["columns_of", "new_folder", "row_struct", "run_parts", "stored", "table", "thinned", "top_of_label", "unpack_row", "with_text"]

ROW = "_row"
#: The optimizer writes sizes it can't tell (tables in memory, results of Python) as numbers of this order.
UNKNOWN_SIZE = 1 << 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder, as an address that Spark and Arrow both accept."""
    base = shared_folder(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def run_parts(df: DataFrame, part_bytes: int = 64 << 20) -> int:
    """Number of partitions for rows that carry their text: at least the session's, more for larger input."""
    spark = df.sparkSession
    size = planned_bytes(df) or 0
    size = size if size < UNKNOWN_SIZE else 0
    unit = min(part_bytes, session_bytes(spark, "spark.sql.files.maxPartitionBytes", 128 << 20))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / unit))


def row_struct(df: DataFrame) -> DataFrame:
    """All columns of a row packed into one, so that added columns can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def with_text(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """Columns ``keep`` packed into one, and the text as ``data``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(ROW), F.col(f"`{text_col}`").alias("data"))


def unpack_row(df: DataFrame, columns: list[str], added: dict[str, str]) -> DataFrame:
    """The packed columns again, and ``added`` columns (name of the result: column here) beside them."""
    taken = {c: F.col(ROW)[c].alias(c) for c in columns if c not in added}
    return df.select(*taken.values(), *[F.col(source).alias(name) for name, source in added.items()])


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def thinned(rows: DataFrame, label: str, id_col: str, most: int, seed: int) -> DataFrame:
    """About twice ``most`` rows of each label (all, where there are fewer), chosen by hashed id, with ``draw`` in 0 to 1.

    Only counts by label are gathered; the rows stay where they are.
    """
    draw = F.xxhash64(F.lit(seed), F.col(id_col)) / F.lit(2.0**64) + 0.5
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_rows"))
    shares = stored(counts.select("_label", (F.lit(2.0 * most) / F.col("_rows")).alias("_share")), "shares")
    return rows.withColumn("draw", draw).join(shares, F.col(label) == F.col("_label")).filter("draw < _share").drop("_label", "_share")


def top_of_label(rows: DataFrame, label: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each label, numbered from 1 in ``n``."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(label).orderBy(*order))).filter(F.col("n") <= most)
