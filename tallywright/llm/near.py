"""Jaccard join of word shingles by chosen paths.

Every set is split on sampled tokens of its own: a token is taken when its hash for the run (below the first
level: for the path so far) is under ``boost / (threshold * size)``, so similar sets take common tokens. Sets
with the same path share a bucket; large buckets are split again. Small buckets are compared set by set; buckets
that stay large to the last level hold sets that agree in several independent tokens and are taken together. Runs
are repeated until a pair at the threshold is missed with a chance below ``miss``.

What meets in a bucket forms candidate groups. Within a group every pair of sets is compared exactly, in blocks
of bounded size spread over tasks; only counts and spanning links leave a task, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallywright.llm.common import columns_of, stored
from tallywright.llm.components import components

SKETCH = 64
#: Sketches estimate a similarity with a deviation of 0.05 at 0.8; a pair is passed on from here.
SLACK = 0.3
#: Tokens hashed at once.
CHUNK = 4096


class WordHashes(dict):
    """64-bit hashes of words; a bounded number is kept."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return value


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words (lower case, cut at white space); a shorter text is one run."""
    parts = (text or "").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    width = min(width, len(codes))
    n = len(codes) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = scramble(out + codes[i : i + n])
    return np.unique(out)


def runs_needed(boost: float, depth: int, miss: float) -> int:
    """Runs until a pair at the threshold is missed with at most that chance, by the branching of ``depth`` levels."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-boost * meets)
    return math.ceil(math.log(miss) / math.log(1 - meets))


def chosen(tokens: np.ndarray, paths: np.ndarray, limit: float) -> np.ndarray:
    """Paths one token longer: for each path those of the tokens whose hash for it lies under the limit."""
    found = []
    for a in range(0, len(tokens), CHUNK):
        keys = scramble(tokens[None, a : a + CHUNK] ^ scramble(paths)[:, None]).ravel()
        found.append(keys if limit >= 1 else keys[keys < np.uint64(int(limit * 2.0**64))])
    return scramble(np.concatenate(found) + np.uint64(1))


def sketch(tokens: np.ndarray) -> bytes:
    """One byte of each of the smallest hashes under ``SKETCH`` orders."""
    seeds = scramble(np.arange(1, SKETCH + 1, dtype=np.uint64))[:, None]
    parts = [((tokens[None, a : a + CHUNK] ^ seeds) * np.uint64(0x9E3779B97F4A7C15)).min(axis=1) for a in range(0, len(tokens), CHUNK)]
    return (scramble(np.minimum.reduce(parts)) & np.uint64(255)).astype(np.uint8).tobytes()


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _mark_batches(width: int, runs: int, share: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, roots = WordHashes(), np.arange(runs, dtype=np.uint64)
        for batch in batches:
            sids, sizes, picks, marks = [], [], [], []
            for value in batch.column(2):
                tokens = shingles(value.as_py(), words, width)
                n = len(tokens)
                sids.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if n else None)
                sizes.append(n)
                picks.append(_signed(chosen(tokens, roots, share / n)) if n else [])
                marks.append(sketch(tokens) if n else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(picks, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["id", "h", "sid", "n", "picks", "sketch"])

    return run


def _token_batches(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [shingles(v.as_py(), words, width) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "tokens"])

    return run


def _longer_paths(share: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(batch.num_rows):
                sid, data, paths = (c[0] for c in columns_of(batch.slice(a, 1), "sid", "tokens", "paths"))
                tokens = np.frombuffer(data, np.uint64)
                found = np.unique(chosen(tokens, np.array(paths, np.int64).view(np.uint64), share / len(tokens)))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64), pa.int64()), pa.array([sid] * len(found), pa.int64())], names=["path", "sid"])

    return run


def _spanning(close: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric relation."""
    seen, out = np.zeros(len(close), bool), []
    for root in range(len(close)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            near = np.flatnonzero(close[todo.pop()] & ~seen)
            seen[near] = True
            out += [(root, j) for j in near.tolist()]
            todo += near.tolist()
    return out


def _compare_bucket(sids: np.ndarray, sizes: np.ndarray, marks: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    alike = np.stack([(marks == row).sum(axis=1) for row in marks]) >= (threshold - SLACK) * SKETCH
    close = alike & (np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes))
    return [(int(sids[a]), int(sids[b])) for a, b in _spanning(close)]


def _bucket_batches(threshold: float):
    """Rows sorted by path: sets of a bucket that are alike by sketch, as spanning edges."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*columns_of(batch, "path", "sid", "n", "sketch")):
                if held and held[0][0] != row[0]:
                    out += _edges_of(held, threshold)
                    held = []
                held.append(row)
            yield _pairs(out)
        yield _pairs(_edges_of(held, threshold))

    return run


def _edges_of(rows: list[tuple[int, int, int, bytes]], threshold: float) -> list[tuple[int, int]]:
    if len(rows) < 2:
        return []
    marks = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), SKETCH)
    return _compare_bucket(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), marks, threshold)


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def common_tokens(left: list[np.ndarray], right: list[np.ndarray], often: int = 8, chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets: frequent tokens as matrix products, rare ones by place."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    every, inverse = np.unique(np.concatenate([s[0] for s in sides]), return_inverse=True)
    cut = len(sides[0][0])
    ids = (inverse[:cut], inverse[cut:])
    counts = [np.bincount(i, minlength=len(every)) for i in ids]
    both = (counts[0] > 0) & (counts[1] > 0)
    frequent = np.flatnonzero(both & (np.maximum(*counts) > often))
    out = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, len(frequent), chunk):
        column = np.full(len(every), -1)
        column[frequent[a : a + chunk]] = np.arange(len(frequent[a : a + chunk]))
        dense = []
        for i, (_, owner), sets in zip(ids, sides, (left, right)):
            m = np.zeros((len(sets), len(frequent[a : a + chunk])), np.float32)
            at = column[i]
            m[owner[at >= 0], at[at >= 0]] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    rare = both & (np.maximum(*counts) <= often)
    order = np.argsort(ids[1], kind="stable")
    begin = np.searchsorted(ids[1][order], np.arange(len(every)))
    mine = np.flatnonzero(rare[ids[0]])
    token = ids[0][mine]
    for k in range(often):
        more = counts[1][token] > k
        mine, token = mine[more], token[more]
        np.add.at(out, (sides[0][1][mine], sides[1][1][order[begin[token] + k]]), 1)
    return out


def _block_pair(threshold: float):
    """Exact comparison of two blocks of a group: links of each set (copies counted) and spanning edges."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        sids, copies, block = (np.array(rows[c].to_pylist(), np.int64) for c in ("sid", "copies", "block"))
        sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"].to_pylist()]
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        links, edges = np.zeros(len(sids), np.int64), []
        if len(left) and len(right):
            shared = common_tokens([sets[i] for i in left], [sets[j] for j in right])
            size = np.array([len(s) for s in sets])
            close = shared >= threshold * (size[left][:, None] + size[right][None, :] - shared) - 1e-9
            if x == y:
                np.fill_diagonal(close, False)
            links[left] += close @ copies[right]
            if x != y:
                links[right] += copies[left] @ close
            n = len(left) + len(right)
            whole = np.zeros((n, n), bool)
            whole[: len(left), len(left) :], whole[len(left) :, : len(left)] = close, close.T
            place = np.r_[left, right]
            edges = [(int(sids[place[a]]), int(sids[place[b]])) for a, b in _spanning(whole) if sids[place[a]] != sids[place[b]]]
        kept = np.flatnonzero(links)
        a = [int(sids[i]) for i in kept] + [e[0] for e in edges]
        b = [None] * len(kept) + [e[1] for e in edges]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links[kept].tolist() + [0] * len(edges), pa.int64())})

    return run


def _several(rows: DataFrame) -> DataFrame:
    """Bucket rows (path, sid) with the size of their bucket, without buckets of one set.

    The sizes are a table of their own, so that adaptive execution can split a bucket with many sets in the join.
    """
    counts = stored(rows.groupBy("path").agg(F.count(F.lit(1)).alias("in_bucket")).filter("in_bucket > 1"), "bucket-sizes")
    return rows.join(counts.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path")).drop("_path")


def _tokens_of(rows: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """(sid, tokens) of the named sets, each from one of its documents. Texts of equal hash have equal sets, so a null id may stand for 0."""
    reps = named.select("sid", F.col("one.h").alias("_h"), F.coalesce("one.id", F.lit(0)).alias("_id"))
    keyed = rows.filter("h IS NOT NULL").select(F.col("h").alias("k"), F.coalesce("id", F.lit(0)).alias("i"), "text")
    texts = keyed.join(reps, (F.col("k") == F.col("_h")) & (F.col("i") == F.col("_id"))).dropDuplicates(["k", "i"])
    return texts.select("sid", "text").mapInArrow(_token_batches(width), "sid bigint, tokens binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8,
         boost: float = 1.6, depth: int = 3, miss: float = 1e-5, bucket: int = 1024, block: int = 512) -> DataFrame:
    """(id, h, class_id, n_links) of every row: the smallest id of its group of linked documents, and how many others it is linked to.

    Two documents are linked when the Jaccard similarity of their sets of ``width``-word shingles reaches the
    threshold; copies count one each. ``h`` is the hash of the text (null for null), so that rows can be told
    apart where ids repeat. Texts without a word, null ones included, have no links and stand alone (class_id is
    their id). Rows with a null id take part; they never give the class its id, and a group of them alone has class
    null. Sets are named by 64-bit hashes. Results don't depend on how rows are dealt.
    """
    share = boost / threshold
    runs = runs_needed(boost, depth, miss)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("h"), F.col(text_col).alias("text"))
    marks = stored(rows.mapInArrow(_mark_batches(width, runs, share), "id bigint, h bigint, sid bigint, n int, picks array<bigint>, sketch binary"), "marks")
    sets = stored(marks.filter("sid IS NOT NULL").groupBy("sid").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"), F.min(F.struct("h", "id")).alias("one"),
        F.first("n").alias("n"), F.first("picks").alias("picks"), F.first("sketch").alias("sketch")), "sets")

    level, edges, tokens = stored(_several(sets.select(F.explode("picks").alias("path"), "sid")), "buckets-1"), [], None
    for step in range(1, depth + 1):
        small = level.filter(F.col("in_bucket") <= bucket).select("path", "sid").join(
            sets.select(F.col("sid").alias("_sid"), "n", "sketch"), F.col("sid") == F.col("_sid")).drop("_sid")
        edges.append(stored(small.repartition("path").sortWithinPartitions("path", "sid").mapInArrow(_bucket_batches(threshold), "a bigint, b bigint").distinct(), "alike"))
        large = level.filter(F.col("in_bucket") > bucket)
        if tokens is None:  # of all sets that can come into a group
            wanted = edges[0].select(F.col("a").alias("_sid")).unionByName(edges[0].select(F.col("b").alias("_sid"))).unionByName(large.select(F.col("sid").alias("_sid"))).distinct()
            tokens = stored(_tokens_of(rows, sets.join(wanted, F.col("sid") == F.col("_sid")).select("sid", "one"), width), "tokens")
        if step == depth:
            heads = large.groupBy(F.col("path").alias("_path")).agg(F.min("sid").alias("b"))
            edges.append(large.join(heads, F.col("path") == F.col("_path")).select(F.col("sid").alias("a"), "b"))
            break
        held = large.groupBy("sid").agg(F.collect_list("path").alias("paths"))  # as many as a set has paths, a bounded number
        longer = held.join(tokens.withColumnRenamed("sid", "_sid"), F.col("sid") == F.col("_sid")).select("sid", "tokens", "paths").mapInArrow(
            _longer_paths(share), "path bigint, sid bigint")
        level = stored(_several(longer), f"buckets-{step + 1}")

    groups = stored(components(reduce(DataFrame.unionByName, edges)), "groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("_size")).select(F.col("root").alias("_root"), F.ceil(F.col("_size") / block).cast("int").alias("blocks"))
    placed = groups.join(sizes, F.col("root") == F.col("_root")).join(sets.select("sid", "copies"), F.col("node") == F.col("sid")).select(
        "root", "blocks", "sid", "copies", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = placed.select("*", other).select("root", "sid", "copies", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    full = pairs.join(tokens.withColumnRenamed("sid", "_sid"), F.col("sid") == F.col("_sid")).drop("_sid")
    compared = stored(full.groupBy("root", "x", "y").applyInArrow(_block_pair(threshold), "a bigint, b bigint, links bigint"), "links")
    linked = compared.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(compared.filter("b IS NOT NULL").select("a", "b"))
    names = roots.join(sets.select("sid", "least_id"), F.col("node") == F.col("sid")).groupBy("root").agg(F.min("least_id").alias("named"))
    named = roots.join(names.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "named")
    each = sets.select("sid", "copies", "least_id").join(named, F.col("sid") == F.col("_node"), "left").join(
        linked.withColumnRenamed("a", "_a"), F.col("sid") == F.col("_a"), "left").select(
        F.col("sid").alias("_sid"), F.coalesce("named", "least_id").alias("named"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = marks.select("id", "h", "sid").join(stored(each, "classes"), F.col("sid") == F.col("_sid"), "left")
    alone = F.col("sid").isNull()
    return out.select("id", "h", F.when(alone, F.col("id")).otherwise(F.col("named")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))
