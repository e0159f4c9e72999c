"""The pipeline's stages against brute force on a small table, and over awkward rows."""

from __future__ import annotations

import re

import corpus_pipeline
from tallywright.llm import queries
from tests.llm.fixtures import awkward
from tests.llm.test_operators import SF, classes


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    flat = lambda t: re.sub(r"\s+", " ", (t or "").lower()).strip()
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, SF)
        kept = out.collect()
        if name == "language":
            assert len(kept) >= 0.99 * before
        if name == "near_duplicates":
            want = {d for d, c, _ in classes([(r.doc_id, r.text) for r in rows]) if d == c}
            assert sorted(r.doc_id for r in kept) == sorted(want)
        if name == "decontamination":
            assert {r.doc_id for r in rows} - {r.doc_id for r in kept} == {r.doc_id for r in rows if any(i in flat(r.text) for i in items)}
        if name == "mixing":
            size = sum(len((r.text or "").split()) for r in rows)
            assert abs(sum(len((r.text or "").split()) for r in kept) - 1.5 * size) < 0.1 * size
        if name == "token_files":
            assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows)
        else:
            assert out.columns == columns
            docs = spark.createDataFrame(kept, docs.schema)


def test_run_gives_the_token_rows(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) >= {"doc_id", "start", "n_tokens", "ids_crc32"}
    assert "pipeline" not in queries.QUERIES and corpus_pipeline.ORACLE_SQL is None


def test_stages_awkward(spark):
    odd = awkward(spark)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = len(out.collect())
            assert n <= 2 * 12 and (name == "token_files" or out.columns == docs.columns)
