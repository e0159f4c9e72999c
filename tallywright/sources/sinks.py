"""Writers: replace one partition, append without repeats, export results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.functions.tables import StoredTable, broadcast_if_small, remove_folder
from tallywright.operators.results import filter_results

EXPORT_COLUMNS = [
    "ID registrazione", "Numero documento", "Data effettiva", "Conto contabile", "Importo netto", "Descrizione",
    "Utente", "Punteggio", "Da investigare", "Criteri scattati", "Fonte", "Riga fonte",
]


def replace_partition(df: DataFrame, path: str, by: str = "engagement_id", replaced: list | None = None) -> None:
    """Replace the partitions present in ``df`` and leave all others as they are.

    ``replaced`` names the values that are meant to be replaced: one of them without rows in ``df`` ends up empty (None
    and a blank text are one partition to Spark). Rows are written to a folder beside the partitions first, so a write
    that fails leaves everything as it was; then each partition is exchanged by renaming. ``df`` may read ``path``.
    """
    spark, draft = df.sparkSession, f"{path}/_draft-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(f"{draft}/new")
    made = {f.getPath().getName() for f in _files(spark, f"{draft}/new") if f.isDirectory()}
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    emptied = {named.getPartitionPathString(by, None if v is None else str(v)) for v in replaced or []}
    for name in sorted(made | emptied):
        if _exists(spark, f"{path}/{name}"):
            _move(spark, f"{path}/{name}", f"{draft}/old/{name}")
        if name in made:
            _move(spark, f"{draft}/new/{name}", f"{path}/{name}")
    remove_folder(spark, draft)


def append_only_write(df: DataFrame, path: str, key: str = "id") -> None:
    """Append rows; a key that repeats in the batch or is already stored stops the write. The batch is computed once."""
    spark = df.sparkSession
    batch = StoredTable(df, "batch")
    rows = batch.read()
    try:
        clash = rows.groupBy(key).count().filter("count > 1").select(key)
        if _exists(spark, path):
            clash = clash.unionByName(rows.select(key).join(spark.read.parquet(path).select(key), key, "left_semi"))
        first = clash.take(1)
        if first:
            raise ValueError(f"repeated {key}: {first[0][0]}")
        rows.write.mode("append").parquet(path)
    finally:
        batch.release()


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _files(spark: SparkSession, path: str) -> list:
    system, place = _place(spark, path)
    return list(system.listStatus(place))


def _move(spark: SparkSession, old: str, new: str) -> None:
    system, place = _place(spark, new)
    system.mkdirs(place.getParent())
    if not system.rename(_place(spark, old)[1], place):
        raise OSError(f"{old} could not be moved to {new}")


def _exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def export_results(
    scored: DataFrame, sources: DataFrame, to_investigate: bool | None = None, account: str | None = None,
    minimum_score: int | None = None,
) -> DataFrame:
    """The flat twelve-column export, in load order, with verdict, reasons and source name."""
    chosen = filter_results(scored, to_investigate, account, minimum_score)
    names = broadcast_if_small(sources.select("source_id", "file_name"))
    named = chosen.join(names, "source_id", "left").orderBy("load_order")
    values = [
        F.col("entry_id"), F.col("document_number"), F.col("effective_date"), F.col("account"), F.col("net_amount"),
        F.col("description"), F.col("user_name"), F.col("risk_score"),
        F.when(F.col("to_investigate"), "Sì").otherwise("No"), F.col("reasons"),
        F.coalesce("file_name", F.lit("")), F.col("row_number"),
    ]
    return named.select(*[v.alias(name) for v, name in zip(values, EXPORT_COLUMNS)])


def write_export(export: DataFrame, path: str, file_format: str = "csv") -> None:
    writer = export.write.mode("overwrite")
    writer.csv(path, header=True) if file_format == "csv" else writer.parquet(path)
