"""Removal of repeated passages by sliding runs of sentences.

A text is cut at line breaks and after ``.``, ``!`` or ``?`` before white space; sentences of over ``LONG`` words are
cut again after words chosen by their hash, so that copies of a passage are cut alike. Runs are the shortest ones from
and to every sentence with at least ``least_sentences`` sentences and ``least_words`` words, and every sentence of
``least_alone`` words. Their hashes are joined over all documents. Every occurrence of a run but the first is removed,
with all sentences it covers.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallywright.llm.common import ROW, stored

BOUNDARY = re.compile(r"\s*\n\s*|(?<=[.!?])\s+")
WORD = re.compile(r"\S+")
#: Words of a sentence that is not cut again, one word in so many ends a piece, and words of a piece at least.
LONG, ONE_IN, LEAST_PIECE = 50, 16, 8


def cut(text: str) -> list[tuple[int, int, int]]:
    """(start, end, next start) of each sentence or piece of a long one; blanks between belong to the sentence before."""
    out, at = [], 0
    for m in BOUNDARY.finditer(text):
        if m.start() > at:
            out += _pieces(text, at, m.start(), m.end())
        at = m.end()
    if at < len(text):
        out += _pieces(text, at, len(text), len(text))
    return out


def _pieces(text: str, start: int, end: int, following: int) -> list[tuple[int, int, int]]:
    if end - start <= 2 * LONG:  # too short for so many words and blanks
        return [(start, end, following)]
    words = list(WORD.finditer(text, start, end))
    if len(words) <= LONG:
        return [(start, end, following)]
    out, since = [], 0
    for word, after in zip(words, words[1:]):
        since += 1
        if since >= LEAST_PIECE and xxhash.xxh64_intdigest(word[0].lower().encode("utf-8", "replace")) % ONE_IN == 0:
            out.append((start, word.end(), after.start()))
            start, since = after.start(), 0
    return [*out, (start, end, following)]


def _shortest(words: list[int], least_sentences: int, least_words: int) -> list[tuple[int, int]]:
    """(first sentence, sentences) of the shortest long enough run from each sentence."""
    out, stop, total = [], 0, 0
    for i in range(len(words)):
        while stop < len(words) and (stop - i < least_sentences or total < least_words):
            total += words[stop]
            stop += 1
        if stop - i < least_sentences or total < least_words:
            break
        out.append((i, stop - i))
        total -= words[i]
    return out


def runs(text: str, least_sentences: int, least_words: int, least_alone: int) -> list[tuple[int, int, int]]:
    """(hash, first sentence, sentences) of the shortest long enough run from and to each sentence, and of each that counts alone."""
    marks, words = [], []
    for start, end, _ in cut(text):
        parts = text[start:end].lower().split()
        marks.append(xxhash.xxh64_intdigest(" ".join(parts).encode("utf-8", "replace")))
        words.append(len(parts))
    data, n = struct.pack(f"<{len(marks)}Q", *marks), len(marks)
    spans = {*_shortest(words, least_sentences, least_words), *((n - i - k, k) for i, k in _shortest(words[::-1], least_sentences, least_words))}
    alone = {(i, 1) for i in range(n) if words[i] >= least_alone}
    spans = {(i, k) for i, k in spans if min(words[i : i + k]) < least_alone} | alone  # sentences that all count alone need no run
    return [(xxhash.xxh64_intdigest(data[8 * i : 8 * (i + k)]) - (1 << 63), i, k) for i, k in sorted(spans)]


def _run_batches(least_sentences: int, least_words: int, least_alone: int):
    """Runs of each text; ``again`` marks a run that occurred before in the same text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for doc, h, text in zip(*(batch.column(i).slice(a, 256).to_pylist() for i in range(3))):
                    seen = set()
                    for value, start, size in runs(text or "", least_sentences, least_words, least_alone):
                        rows.append((value, doc, h, start, size, value in seen))
                        seen.add(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["hash", "doc", "h", "start", "size", "again"])

    return run


def _clean_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, removed = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            pieces = cut(text or "")
            gone = set()
            for s in spans or ():
                gone.update(range(s["start"], s["start"] + s["size"]))
            texts.append(text if text is None or not gone else "".join(text[a:c] for i, (a, _, c) in enumerate(pieces) if i not in gone))
            counts.append(len(pieces))
            removed.append(sorted(gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(removed, pa.list_(pa.int32()))],
            names=[ROW, "text", "n_sentences", "removed"])


def deduplicate(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", least_sentences: int = 2, least_words: int = 15, least_alone: int = 15) -> DataFrame:
    """Columns ``keep`` packed as ``_row``, the text without its repeated passages, n_sentences and removed (their numbers).

    The first occurrence is that in the document of the smallest id, and there the first in the text. Rows with
    the same id count as one document: the first of a passage stays in each of them. Rows without an id come
    before all others, ordered by a hash of their text. Null texts stay null; empty texts and texts without a
    long enough run stay as they are; a text wholly repeated becomes empty. An empty table gives an empty result.
    """
    h = F.xxhash64(F.col(text_col))
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)) + F.pmod(h, F.lit(1 << 62)))
    rows = docs.select(doc.alias("doc"), h.alias("h"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias(ROW))
    found = stored(rows.select("doc", "h", "text").mapInArrow(
        _run_batches(least_sentences, least_words, least_alone), "hash bigint, doc bigint, h bigint, start int, size int, again boolean"), "runs")
    # a table of its own, so that adaptive execution can split a passage with many occurrences in the join
    firsts = stored(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).filter("n > 1"), "firsts")
    repeated = found.join(firsts.select(F.col("hash").alias("_hash"), "first"), F.col("hash") == F.col("_hash")).filter("again OR doc <> first")
    spans = repeated.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "size")).alias("spans"))  # at most three times as many as a text has sentences
    spans = stored(spans.select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), "spans"), "repeated")
    joined = rows.join(spans, (F.col("doc") == F.col("_doc")) & (F.col("h") == F.col("_h")), "left").select(ROW, "text", "spans")
    inner = joined.schema[ROW].dataType.simpleString()
    return joined.mapInArrow(_clean_batches, f"{ROW} {inner}, text string, n_sentences int, removed array<int>")
