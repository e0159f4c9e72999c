"""Five stages from documents to token files; each reads what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.llm import contamination, language, mixing, near, token_files
from tallywright.llm.common import new_folder, table, unpack_row
from tallywright.llm.queries import learnable_language


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; rejected ones, texts without a letter among them, go."""
    model = language.fit(docs.filter(learnable_language()))
    return unpack_row(language.identify(docs, model, docs.columns).filter(~F.col("rejected")), docs.columns, {})


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    A row that repeats another's id and text goes too. Documents without an id go where one with an id is in
    their group; a group without any id keeps one document of each text.
    """
    kept = near.join(docs).filter(F.col("id").eqNullSafe(F.col("class_id"))).select(F.col("id").alias("_kept_id"), F.col("h").alias("_kept_hash")).distinct()
    h = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    marked = docs.withColumn("_text_hash", h)
    joined = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & F.col("_text_hash").eqNullSafe(F.col("_kept_hash")), "left_semi")
    return joined.dropDuplicates(["doc_id", "_text_hash"]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    clean = contamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), docs.columns, clean_only=True)
    return unpack_row(clean, docs.columns, {})


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: none, once or twice."""
    return mixing.copies_of(mixing.mix(docs), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet files, and what they hold of each document."""
    folder, files = token_files.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_ids(spark, folder, files)


STAGES = [
    ("language", identified),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", tokens),
]
#: No stage can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
