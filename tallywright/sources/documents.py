"""Inventory of a document folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywright.constants import ALLOWED_EXTENSIONS, JUNK_NAMES, JUNK_PREFIXES, SKIPPED_FOLDERS, TEMPLATE_NAME_PATTERN
from tallywright.functions.text import document_key, normalise_path
from tallywright.functions.parsing import strip
from tallywright.sources.text_files import text_decode


def file_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-1))


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def document_inventory(files: DataFrame, excerpt_length: int = 280) -> DataFrame:
    """Usable documents of (engagement_id, path, size_bytes, text); junk, templates, skipped folders
    and other extensions are left out. The excerpt is the squeezed text, or the path without text."""
    listed = files.withColumn("rel_path", normalise_path(F.col("path")))
    listed = listed.withColumn("name", file_name(F.col("rel_path")))
    listed = listed.withColumn("extension", file_extension(F.col("name")))
    name = F.col("name")
    junk = F.lower(name).isin(JUNK_NAMES)
    for prefix in JUNK_PREFIXES:
        junk = junk | name.startswith(prefix)
    parts = F.split("rel_path", "/")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skipped = F.arrays_overlap(parents, F.array(*[F.lit(f) for f in SKIPPED_FOLDERS]))
    usable = listed.filter(
        ~junk & ~name.rlike(TEMPLATE_NAME_PATTERN) & ~skipped & F.col("extension").isin(ALLOWED_EXTENSIONS)
    )
    squeezed = strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    excerpt = F.when(squeezed != "", F.left(squeezed, F.lit(excerpt_length))).otherwise(F.col("rel_path"))
    return usable.withColumns(
        {"document_id": document_key(F.col("engagement_id"), F.col("rel_path")), "excerpt": excerpt}
    ).drop("path")


def read_documents(spark: SparkSession, root: str, engagement_id: str) -> DataFrame:
    """Files below ``root`` with decoded text, ready for the inventory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace("path", f"^(file:)?/*{base.lstrip('/')}/", "")
    decoded = text_decode(files)
    textual = file_extension(file_name(F.col("path"))).isin(".txt", ".csv", ".xml", ".json")
    return decoded.select(
        F.lit(engagement_id).alias("engagement_id"),
        relative.alias("path"),
        F.col("length").alias("size_bytes"),
        F.when(textual, F.col("text")).alias("text"),
    )
