"""The quality query and the sentence spans against plain versions of their present rules."""

from __future__ import annotations

import math
import random
import zlib

import zstandard
from pyspark.sql import functions as F

from tallywright.llm import quality, queries, sentences
from tallywright.llm.common import ROW
from tests.llm.fixtures import prose, words

SF = "/root/testdata/sf0.001"


def plain_score(text: str, model: quality.Model) -> tuple[float, float]:
    """Score and difference by compressors made for this text alone."""
    data = text.encode()
    good, bad = (
        len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d) if d else None,
                                     write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))
        for d in (model.good, model.bad))
    d, r, n = (bad - good) / (bad + good), (good + bad) / (2 * len(data) + 40), math.log1p(len(data))
    x, s, k = 10 * d, r, n / 10
    z = sum(w * v for w, v in zip(model.weights, (1, x, x * k, x * abs(x), s, k, s * s, s * k)))
    return 1 / (1 + math.exp(-max(-35, min(35, z)))), d


def test_quality_query_equals_plain_compression(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.fit(docs, labels.filter(~held))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op2_quality_compression(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        score, difference = plain_score(texts[r.doc_id], model)
        assert abs(r.score - score) < 1e-9 and abs(r.difference - difference) < 1e-12
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


def test_held_out_labels_play_no_part(spark, tmp_path):
    """The query gives the same scores where all held-out labels are turned round."""
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    turned = tmp_path / "turned"
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(str(turned / "documents.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(str(turned / "labels.parquet"))
    first, second = ({r.doc_id: r.score for r in queries.op2_quality_compression(spark, str(p)).collect()} for p in (tmp_path, turned))
    assert first == second


def spans_of(text: str, least_sentences: int, least_words: int, least_alone: int) -> list[tuple[tuple, int, int]]:
    """Runs of a text by trying all of them: (words of its sentences, first sentence, sentences)."""
    keys = [tuple(text[a:b].lower().split()) for a, b, _ in sentences.cut(text)]
    long_enough = lambda i, j: j - i >= least_sentences and sum(map(len, keys[i:j])) >= least_words
    found = set()
    for i in range(len(keys)):
        found |= {(i, j) for j in [next((j for j in range(i + 1, len(keys) + 1) if long_enough(i, j)), None)] if j}
        found |= {(k, i + 1) for k in [next((k for k in range(i, -1, -1) if long_enough(k, i + 1)), None)] if k is not None}
    found = {(i, j) for i, j in found if any(len(w) < least_alone for w in keys[i:j])}
    found |= {(i, i + 1) for i, w in enumerate(keys) if len(w) >= least_alone}
    return [(tuple(keys[i:j]), i, j) for i, j in sorted(found)]


def without_repeats(rows: list[tuple[int, str]], least_sentences: int = 2, least_words: int = 15, least_alone: int = 15) -> dict[int, str]:
    """Every occurrence of a run but the first, in order of document and place, taken out."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        pieces, gone, new = sentences.cut(text), set(), set()
        for run, i, j in spans_of(text, least_sentences, least_words, least_alone):
            if run in seen or run in new:
                gone.update(range(i, j))
            new.add(run)
        seen |= new
        out[doc_id] = "".join(text[a:c] for i, (a, _, c) in enumerate(pieces) if i not in gone) if gone else text
    return out


def cleaned(spark, rows: list[tuple[int, str]]) -> dict[int, str]:
    return {r[ROW].doc_id: r.text for r in sentences.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()}


def test_spans_equal_all_runs_of_the_rule(spark):
    """Short and long sentences, drawn again and again, so that runs end and begin inside passages and single sentences repeat."""
    r = random.Random(12)
    pool = [" ".join(words(i, r.choice((2, 3, 5, 8, 14, 15, 16, 25)))) + r.choice(".!?") for i in range(60)]
    pool += [" ".join(words(900 + i, r.choice((51, 80, 130)))) + "." for i in range(6)]
    rows = []
    for i in range(80):
        at = r.randrange(len(pool) - 8)
        rows.append((i, r.choice((" ", "\n")).join([*r.sample(pool, r.randint(0, 6)), *pool[at : at + r.randint(0, 8)], *r.sample(pool, r.randint(0, 3))])))
    want = without_repeats(rows)
    assert cleaned(spark, rows) == want and sum(want[i] != t for i, t in rows) > 20


def test_spans_of_the_smallest_tables_equal_the_rule(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert cleaned(spark, rows) == without_repeats(rows)


def test_forward_runs_alone_would_differ(spark):
    """A passage that ends in short sentences: only runs to each sentence reach its end."""
    passage = f"{prose(1, 7)} {prose(2, 7)} {prose(3, 5)} {prose(4, 3)}"
    rows = [(1, passage), (2, f"{prose(5, 7)} {passage} {' '.join(words(6, 40))}.")]
    assert prose(4, 3) not in cleaned(spark, rows)[2] and cleaned(spark, rows) == without_repeats(rows)
