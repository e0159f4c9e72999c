"""Registered queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywright.llm import contamination, language, licenses, mixing, near, quality, search, secrets, sentences, sharding, token_files, variants, whitening
from tallywright.llm.common import ROW, table


def remainder(column: str, divisor: int):
    return F.crc32(F.col(column).cast("string")) % divisor


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 100th vector against all vectors, ten best."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", search.scaled(F.col("embedding")).alias("vector")).filter("vector IS NOT NULL")
    return search.top_k(rows, rows.filter("vec_id % 100 = 0"), k=10)


def op2_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; labels of the held-out fifth are never read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = quality.fit(docs, labels.filter(~held_out))
    scored = quality.score(docs, model, ["doc_id"]).withColumn("doc_id", F.col(ROW)["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages found in documents, one row each."""
    found = contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(F.col(ROW)["doc_id"].alias("doc_id"), F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence; a document is a file of its source's folder."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("unnamed")), F.lit(".txt"))
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"], F.concat_ws("/", F.coalesce("source", F.lit("unknown")), name))
    return found.select(F.col(ROW)["doc_id"].alias("doc_id"), "path", "license", "kind", "score")


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages."""
    cleaned = sentences.deduplicate(table(spark, sf_dir, "documents"), ["doc_id"])
    return cleaned.select(F.col(ROW)["doc_id"].alias("doc_id"), "text", "n_sentences", F.size("removed").alias("n_removed"), "removed")


def op6_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base rules, all spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    based = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        F.col(ROW)["doc_id"].alias("doc_id"), *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(secrets.span_text(based), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def learnable_language():
    """Rows that the language models may learn from."""
    return F.coalesce(remainder("doc_id", 4) != 2, F.lit(True))


def op7_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; the held-out quarter's is never read."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(learnable_language()).select("doc_id", "text", "lang"))
    found = language.identify(docs, model, ["doc_id"]).withColumn("doc_id", F.col(ROW)["doc_id"])
    return found.select("doc_id", (~learnable_language()).alias("held_out"), "lang_pred", "score", "rejected", "entropy")


def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, sized=mixing.sizes_of(docs))
    return mixed.select(F.col(ROW)["doc_id"].alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates and number of links."""
    return near.join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op10_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written to wavelet files and read back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    folder, files = token_files.write_ids(table(spark, sf_dir, "documents"), path)
    return token_files.read_ids(spark, folder, files)


def op11_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to eight shards of nearly equal bytes and read back."""
    files = sharding.write_shards(table(spark, sf_dir, "documents"), shards=8)
    return files.select(
        "doc_id", sharding.size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whitened by the first eight components of their covariance."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whitening.whole_numbers(F.col("embedding")).alias("x")).filter("x IS NOT NULL")
    model = whitening.fit(rows, components=8)
    error = whitening.identity_error(rows, model) if model else 0.0
    return whitening.whiten(rows, model).withColumn("identity_error", F.lit(error))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_exact_top_k, op2_quality_compression, op3_decontamination, op4_license_scan, op5_sentence_spans, op6_secret_automaton,
    op7_kneser_ney_language, op8_pivotal_mixing, op9_chosen_path_join, op10_wavelet_token_files,
    op11_sampled_splitters, op12_refined_whitening, op13_spelling_variants)}
#: None of these can be written in SQL: they rest on seeded draws, trained models or scans by position.
ORACLE: dict[str, str] = {}
