"""Token ids of a corpus in order of document id, written as wavelet files and read back."""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallywright.llm import wavelet
from tallywright.llm.common import new_folder, run_parts, stored

BLANK = re.compile("[ \n]+")
#: Letters (one code point each, in either case) and marks of a word that a lower-casing tokenizer cuts into these two pieces. No mark
#: begins a contraction or an added token.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ž"
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
SIMPLE = f"^[{LETTERS}]*[{re.escape(MARKS)}]*$"
EACH_LETTER = "".join(c for c in map(chr, range(0x180)) if re.match(f"[{LETTERS}]", c))
#: Byte-level tokenizers write a byte as a visible character: its own, or the next one from 256 on.
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_LEVEL = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
AS_BYTES = "".join(BYTE_LEVEL[b] for b in range(256))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


assert array("I").itemsize == 4 and sys.byteorder == "little"


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark spreads the work
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat``, those numbered ``which`` one after another, and where each of them ends."""
    counts = sizes[which]
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - counts), counts)], ends


class WordEncoder:
    """Ids of whole texts, with the ids of pieces of words kept for later texts.

    Only for tokenizers whose text is cut at white space before the merges and that drop it: then a text's ids
    are those of its words between spaces and line breaks, one after another. ``splits`` tells whether a
    tokenizer is of that kind; others encode each text at once. A word of letters and marks has the ids of its
    lower-case letters and those of its marks, if ``cuts`` holds; many words share these pieces. Other words are
    encoded whole. Kept pieces are bounded, not texts.
    """

    def __init__(self, path: str, kept: int = 100_000):
        self.model, self.kept = tokenizer(path), kept
        self.merge = self.model.model.tokenize
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.by_word = self.splits()
        self.by_piece = self.by_word and self.cuts()

    def splits(self) -> bool:
        probe = ["a b", "x\ny", "'s the", "é 1", "A  B."]
        return all(self._plain(p) == [i for w in BLANK.split(p) for i in self._plain(w)] for p in probe)

    def cuts(self) -> bool:
        letters = ["The", "tokenization", "etc", "Wh", "Ingthatou", "a", "Óciónes", "Ärßöø", "Šžçœ", ""]
        marks = ["", ".", ".,", "!?", "***", ".###", "!$&&&", MARKS, MARKS[::-1], *MARKS]
        return all(self._plain(x + y) == self._merged([x.lower(), y]) for x in letters for y in marks)

    def _plain(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _merged(self, pieces: list[str]) -> list[int]:
        return [t.id for p in self._shown(pieces) for t in self.merge(p)]

    def _shown(self, pieces: list[str]) -> list[str]:
        return " ".join(pieces).encode().decode("latin-1").translate(AS_BYTES).split(BYTE_LEVEL[32])

    def _learn(self, pieces: list[str], simple: list[bool]) -> None:
        """Ids of pieces not seen lately. Pieces of before the last change of generation are taken over; of the others, simple ones
        get the library's merges without its checks for other scripts."""
        older, merged, plain = self.older, [], []
        for piece, one in zip(pieces, simple):
            if piece in older:
                self.pieces[piece] = older[piece]
            else:
                (merged if one else plain).append(piece)
        for piece, shown in zip(merged, self._shown(merged)):
            self.pieces[piece] = array("I", [t.id for t in self.merge(shown)]).tobytes()
        if plain:
            self.pieces.update((w, _packed(e.ids)) for w, e in zip(plain, self.model.encode_batch_fast(plain, add_special_tokens=False)))

    def _simple(self, words: pa.Array) -> pa.Array:
        return pc.match_substring_regex(words, SIMPLE) if self.by_piece else pa.repeat(False, len(words))

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words one after another, where each begins and how many it has."""
        simple = self._simple(words)
        heads = pc.if_else(simple, pc.utf8_lower(pc.ascii_rtrim(words, MARKS)), words)
        tails = pc.if_else(simple, pc.utf8_ltrim(words, EACH_LETTER), "")
        cut = pa.concat_arrays([heads, tails]).dictionary_encode()
        pieces = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.pieces.get, pieces))
        fresh = [i for i, x in enumerate(ids) if x is None]
        if fresh:
            self._learn([pieces[i] for i in fresh], self._simple(cut.dictionary.take(pa.array(fresh, pa.int32()))).to_pylist())
        for i in fresh:
            ids[i] = self.pieces[pieces[i]]
        sizes = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        flat, ends = _runs(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes, cut.indices.to_numpy().reshape(2, -1).T.ravel())
        ends = ends[1::2]
        sizes = np.diff(ends, prepend=0)
        return flat, ends - sizes, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; null texts have none.

        The words of all texts are cut and numbered at once; only pieces of different ones are looked up, and the ids are laid out by their numbers.
        """
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            found = [e.ids for e in self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], "i8")
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        out, ends = _runs(*self._word_ids(words.dictionary), words.indices.to_numpy())
        if len(self.pieces) > self.kept:
            self.pieces, self.older = {}, self.pieces
        reached = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return out, np.diff(reached)


@cache
def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that common pieces are learned once and not in every task.

    A worker keeps it for its later tasks, of other stages as well, so it holds few pieces: those of the last batches.
    """
    return WordEncoder(path)


def _put(folder: str, name: str, data: bytes) -> None:
    """Whole files only: written under a name of its own, then moved to its place; a rerun replaces it by the same bytes."""
    system, path = fs.FileSystem.from_uri(folder)
    draft = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as stream:
        stream.write(data)
    system.move(draft, f"{path}/{name}")


def _slices(texts: pa.Array, most: int = 3 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes, so that the arrays made of their words stay small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8"))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _write_batches(path: str, folder: str, end_id: int, shard_ids: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        part, shard, doc_ids, lengths, parts, size = None, 0, [], [], [], 0

        def close():
            name = f"part-{part:06d}-{shard:06d}.wvm"
            ids = np.concatenate(parts)
            _put(folder, name, wavelet.pack(doc_ids, lengths, ids))
            return pa.RecordBatch.from_pylist([{"name": name, "part": part, "shard": shard, "n_docs": len(doc_ids), "n_ids": len(ids)}],
                                              schema=pa.schema([("name", pa.string()), ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for a, b in _slices(batch.column(1)):
                ids, counts = words.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                ends, begin = np.cumsum(counts + 1), 0
                for doc_id, count, end in zip(batch.column(0).slice(a, b - a).to_pylist(), (counts + 1).tolist(), ends.tolist()):
                    doc_ids.append(doc_id)
                    lengths.append(count)
                    size += count
                    if size >= shard_ids:
                        parts.append(ids[begin:end])
                        begin = end
                        yield close()
                        shard, doc_ids, lengths, parts, size = shard + 1, [], [], [], 0
                parts.append(ids[begin:])
        if doc_ids:
            yield close()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
              shard_ids: int = 1 << 20) -> tuple[str, DataFrame]:
    """Encode every whole text, add ``end_id`` and write wavelet files in ascending order of id.

    Returns the folder and the written list of files (name, part, shard, n_docs, n_ids, start). Null texts count
    as empty and give the end id alone. A null id comes first. Rows with equal ids stay apart, ordered by text;
    equal rows in any order. A file holds about ``shard_ids`` ids and never parts of a document. An empty
    table gives no file. A lost task is run again over the same rows and writes the same files again.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (None, folder)
    folder = folder if system else f"file://{folder}"
    fs.FileSystem.from_uri(folder)[0].create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"),
                       F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "h", "row"]
    dealt = rows.repartitionByRange(run_parts(docs), *order).sortWithinPartitions(*order)
    files = dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(
        _write_batches(tokenizer_path, folder, end_id, shard_ids), "name string, part int, shard int, n_docs bigint, n_ids bigint")
    listed = stored(files, "token-files")
    parts = listed.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select(F.col("part").alias("_part"), F.coalesce(
        F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = listed.withColumn("_inside", inside).join(before, F.col("part") == F.col("_part")).select(
        *listed.columns, (F.col("_before") + F.col("_inside")).alias("start"))
    return folder, stored(starts, "token-starts")


def _read_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1)):
            doc_ids, lengths, matrix = wavelet.unpack(content.as_py())
            ids, ends = matrix.decode().astype("<u4"), np.cumsum(lengths)
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name.as_py()] * len(doc_ids), pa.string()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["name", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document in the files, decoded from their bit planes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wvm").schema(
        "path string, modificationTime timestamp, length bigint, content binary").load(folder)
    rows = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(
        _read_batches, "name string, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    place = files.select(F.col("name").alias("_name"), F.col("start").alias("_start"))
    return rows.join(place, F.col("name") == F.col("_name")).select(
        "doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("file"))
