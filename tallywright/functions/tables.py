"""Constant tables, size-checked broadcasts and the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULT_BROADCAST_BYTES = 10 * 1024 * 1024


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def _split_schema(schema: str) -> list[tuple[str, str]]:
    parts, depth, current = [], 0, ""
    for char in schema:
        depth += {"<": 1, "(": 1, ">": -1, ")": -1}.get(char, 0)
        if char == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += char
    return [tuple(part.strip().split(" ", 1)) for part in [*parts, current]]


def constant_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table known at planning time, so the optimizer sees its exact size."""
    fields = _split_schema(schema)
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    body = rows or [tuple(None for _ in fields)]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in body)
    table = spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
    return table if rows else table.limit(0)


def planned_bytes(df: DataFrame) -> int | None:
    """Size the optimizer expects, read without running anything."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except Exception:
        return None


def broadcast_if_small(df: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast only when the planned size of ``bound`` is under the session's threshold.

    ``bound`` is a table that can only have at least as many rows as ``df`` (by default ``df``
    itself). Beyond the threshold, or when the size is unknown, the join stays a shuffle join that
    adaptive execution may still change or split at run time.
    """
    size = planned_bytes(df if bound is None else bound)
    limit = session_bytes(df.sparkSession, "spark.sql.autoBroadcastJoinThreshold", DEFAULT_BROADCAST_BYTES)
    if size is not None and 0 <= size <= limit:
        return F.broadcast(df)
    return df


#: A row of two text keys and a flag as the planner counts it.
KEY_ROW_BYTES, LEAST_ROW_BYTES = 100, 8


def broadcast_if_bounded(df: DataFrame, source: DataFrame, rows_each: int) -> DataFrame:
    """Hint a broadcast of ``df``, which has at most one row per ``rows_each`` rows of ``source``, where that bound is small.

    ``source`` has at most its planned bytes over the least size of a row as rows.
    """
    size = planned_bytes(source)
    limit = session_bytes(df.sparkSession, "spark.sql.autoBroadcastJoinThreshold", DEFAULT_BROADCAST_BYTES)
    if size is not None and 0 <= size // LEAST_ROW_BYTES // max(rows_each, 1) * KEY_ROW_BYTES <= limit:
        return F.broadcast(df)
    return df


def session_bytes(spark: SparkSession, key: str, default: int) -> int:
    """A session setting in bytes, written plainly or with a unit."""
    text = str(spark.conf.get(key, str(default))).strip().lower()
    for unit, factor in (("kb", 1024), ("mb", 1024**2), ("gb", 1024**3), ("k", 1024), ("m", 1024**2), ("g", 1024**3), ("b", 1)):
        if text.endswith(unit):
            return int(float(text[: -len(unit)]) * factor)
    return int(text)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; set here only when the cluster names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="tallywright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # this process made it for itself
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class StoredTable:
    """A result on the shared folder, written when it is first read and removed by ``release``.

    Used where several steps share one costly result: they start from the table, which survives the loss of executors
    and cuts the lineage. Making the handle runs nothing.
    """

    def __init__(self, df: DataFrame, name: str):
        self.source, self.schema, self.spark = df, df.schema, df.sparkSession
        self.name, self.path = name, None

    def read(self) -> DataFrame:
        if self.path is None:
            path = f"{shared_folder(self.spark)}/{self.name}-{uuid.uuid4().hex}"
            self.source.write.parquet(path)
            self.path, self.source = path, None
        return self.spark.read.schema(self.schema).parquet(self.path)

    def release(self) -> None:
        if self.path is not None:
            remove_folder(self.spark, self.path)


HELD: dict[tuple[str, str, str], StoredTable] = {}


def held(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from the data at ``source``: stored by the first who asks, read by all others of the session."""
    key = spark.sparkContext.applicationId, name, source
    if key not in HELD:
        HELD[key] = StoredTable(build(), name)
    return HELD[key].read()


def release_held(spark: SparkSession) -> None:
    """Remove all tables that ``held`` has stored in this session."""
    for key in [k for k in HELD if k[0] == spark.sparkContext.applicationId]:
        HELD.pop(key).release()


def stored(df: DataFrame, name: str) -> DataFrame:
    """A result written to the shared folder and read back; it stays there for as long as the folder does."""
    return StoredTable(df, name).read()
