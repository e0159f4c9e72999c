"""Benchmark passages in documents: q-gram counting in diagonal bands, then banded alignment.

A passage of m characters that occurs with at most e edits keeps at least ``m - q + 1 - q * e`` of its q-grams,
and their diagonals (place in the document less place in the passage) lie within e + 1 neighbours. So shared
q-grams are counted in bands of 2 * (e + 1) diagonals that overlap by half; a band below the bound can hold no
occurrence, one that reaches it is aligned within its diagonals. Texts are compared in lower case with runs of
white space as one blank; places are those of the original text, in code points.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywright.llm.common import ROW, stored, with_text
from tallywright.llm.language import HashArray

MIX = np.uint64(0x9E3779B97F4A7C15)
LEAK = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>"
LEAK_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


@cache
def _folding() -> np.ndarray:
    """Lower case of each code point where it is one code point; white space becomes a blank."""
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isspace():
            lower[c] = 32
        elif s.lower() != s and len(s.lower()) == 1:
            lower[c] = ord(s.lower())
    return lower


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points and their places in the text."""
    codes = _folding()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = np.r_[codes[:1] != 32, (codes[1:] != 32) | (codes[:-1] != 32)]
    if len(codes) and codes[-1] == 32:  # no blank at the end
        last = np.flatnonzero(codes != 32)
        keep[(last[-1] + 1 if len(last) else 0) :] = False
    return codes[keep], np.flatnonzero(keep)


def window_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each run of q codes, from runs of half the length."""
    def runs(width: int) -> np.ndarray:
        if width == 1:
            return (codes.astype(np.uint64) + np.uint64(1)) * MIX
        half = width // 2
        left, right = runs(half), runs(width - half)
        n = len(codes) - width + 1
        out = left[:n] * np.uint64(0xBF58476D1CE4E5B9) + right[half : half + n]
        return out ^ out >> np.uint64(31)

    return runs(q) * np.uint64(0x94D049BB133111EB) if len(codes) >= q else np.zeros(0, np.uint64)


class Passage(NamedTuple):
    item_id: int
    codes: np.ndarray
    edits: int  # budget
    least: int  # q-grams that an occurrence keeps


class Index:
    """All passages, by the length of their q-grams.

    A passage of m characters and e edits has a bound of at least one q-gram as long as ``q`` is at most m / (e + 1). So
    passages for which the wanted length is too much get shorter q-grams, in an index of their own, and every one
    has its full budget.
    """

    def __init__(self, items: list[tuple[int, str | None]], q: int, error_rate: float):
        self.short: dict[int, dict[bytes, list[int]]] = {}
        by_length: dict[int, list[Passage]] = {}
        for item_id, text in items:
            codes = normal(text or "")[0]
            if len(codes) >= q:
                edits = int(error_rate * len(codes))
                own = min(q, len(codes) // (edits + 1))
                by_length.setdefault(own, []).append(Passage(item_id, codes, edits, len(codes) - own + 1 - own * edits))
            elif len(codes):  # shorter than a q-gram: found as a whole, without edits
                self.short.setdefault(len(codes), {}).setdefault(codes.tobytes(), []).append(item_id)
        self.grams = [Grams(passages, own) for own, passages in sorted(by_length.items())]

    def leaks(self, text: str) -> list[dict]:
        """Occurrences in one text: item_id, start, end, edits; overlapping ones of an item count once, the best."""
        codes, places = normal(text)
        found: list[tuple[int, int, int, int]] = []
        for length, wanted in self.short.items():
            hashes = {window_hashes(np.frombuffer(k, np.uint32), length)[0]: k for k in wanted}
            at = np.flatnonzero(np.isin(window_hashes(codes, length), np.array(list(hashes), np.uint64)))
            for i in at.tolist():
                found += [(item, i, i + length, 0) for item in wanted.get(codes[i : i + length].tobytes(), [])]
        for grams in self.grams:
            found += grams.found(codes)
        best: list[tuple[int, int, int, int]] = []
        for x in sorted(found, key=lambda x: (x[0], x[3], x[1], x[2])):
            if all(x[0] != y[0] or x[2] <= y[1] or y[2] <= x[1] for y in best):
                best.append(x)
        return [{"item_id": i, "start": int(places[a]), "end": int(places[b - 1]) + 1, "edits": e} for i, a, b, e in sorted(best)]


class Grams:
    """q-grams of one length, with the passages and places they come from."""

    def __init__(self, passages: list[Passage], q: int):
        self.q, self.passages = q, passages
        grams = [window_hashes(p.codes, q) for p in self.passages]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner, place = (np.concatenate([f(g, i) for i, g in enumerate(grams)]) if grams else np.zeros(0, np.int64)
                        for f in (lambda g, i: np.full(len(g), i, np.int64), lambda g, i: np.arange(len(g), dtype=np.int64)))
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.keys = HashArray(keys)
        self.width = np.array([p.edits + 1 for p in self.passages], np.int64)
        self.least = np.array([p.least for p in self.passages], np.int64)
        self.longest = max([len(p.codes) + p.edits for p in self.passages], default=0)

    def bands(self, codes: np.ndarray, most: int = 2_000_000) -> list[tuple[int, int]]:
        """(passage, band) pairs that reach the bound; band b covers diagonals b * (e + 1) to (b + 2) * (e + 1) - 1."""
        at = self.keys.find(window_hashes(codes, self.q))
        hits = np.flatnonzero(at >= 0)
        if not len(hits):
            return []
        count, first = self.count[at[hits]], self.first[at[hits]]
        cuts = np.unique(np.r_[0, np.searchsorted(np.cumsum(count), np.arange(most, count.sum() + most, most)), len(hits)])
        likely = np.zeros(len(self.passages), np.int64)  # a passage below its bound on all diagonals is so in any band
        for a, b in zip(cuts[:-1], cuts[1:]):
            likely += np.bincount(self.owner[_spread(first[a:b], count[a:b])], minlength=len(likely))
        likely = likely >= self.least
        if not likely.any():
            return []
        width, least = self.width, self.least
        shift, keys, sums = len(codes) + 2, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            source = _spread(first[a:b], count[a:b])
            owner = self.owner[source]
            mine = likely[owner]
            owner = owner[mine]
            diagonal = (np.repeat(hits[a:b], count[a:b]) - self.place[source])[mine]
            band = diagonal // width[owner] + self.longest + 1  # never below 0
            both = np.concatenate([owner * (shift + 2 * self.longest) + band, owner * (shift + 2 * self.longest) + band - 1])
            got, n_got = np.unique(np.concatenate([keys, both]), return_inverse=True)
            sums = np.bincount(n_got, np.r_[sums, np.ones(len(both), np.int64)], len(got)).astype(np.int64)
            keys = got
        owner, band = keys // (shift + 2 * self.longest), keys % (shift + 2 * self.longest) - self.longest - 1
        good = sums >= least[owner]
        return list(zip(owner[good].tolist(), band[good].tolist()))

    def found(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Occurrences in normalised text: item id, start, end, edits."""
        out: list[tuple[int, int, int, int]] = []
        regions: list[list[int]] = []
        for owner, band in sorted(self.bands(codes)):
            step = self.passages[owner].edits + 1
            low, high = band * step, (band + 2) * step - 1
            if regions and regions[-1][0] == owner and low <= regions[-1][2] + 1:
                regions[-1][2] = high
            else:
                regions.append([owner, low, high])
        for owner, low, high in regions:
            p = self.passages[owner]
            out += [(p.item_id, *x) for x in occurrences(p.codes, codes, low, high, p.edits)]
        return out


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each pair of a first index and a count."""
    return np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def occurrences(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the item in the text on diagonals low to high, not overlapping, fewest edits first."""
    found, todo = [], [(max(0, low - budget), min(len(text), high + budget + len(item)))]
    while todo:
        a, b = todo.pop()
        if b - a < len(item) - budget:
            continue
        piece = text[a:b]
        at = _exact(item, piece)
        if at >= 0:
            start, end, edits = at, at + len(item), 0
        else:
            ends = _align(item, piece, low - a, high - a, True)
            end = int(ends.argmin())
            edits = int(ends[end])
            if edits > budget:
                continue
            back = piece[:end][::-1]
            starts = _align(item[::-1], back, -budget, budget, False)
            start = end - int(starts.argmin())
        if end <= start:
            continue
        found.append((a + start, a + end, edits))
        todo += [(a, a + start), (a + end, b)]
    return found


def _exact(item: np.ndarray, text: np.ndarray) -> int:
    """First place of the item in the text, -1 where it has none."""
    data, wanted, at = text.astype("<u4").tobytes(), item.astype("<u4").tobytes(), -1
    while True:
        at = data.find(wanted, at + 1)
        if at < 0 or at % 4 == 0:
            return at // 4 if at >= 0 else -1


def _align(item: np.ndarray, text: np.ndarray, low: int, high: int, free_start: bool) -> np.ndarray:
    """Edits of the whole item against text that ends at each place, on diagonals low - e to high + e only."""
    extra = len(item) // 8 + 1
    low, high = low - extra, high + extra
    ladder, far = np.arange(high - low + 1), len(item) + len(text) + 1
    place = low + ladder  # column of the text for each diagonal in row 0
    row = np.where((place >= 0) & (place <= len(text)), 0 if free_start else np.abs(place), far)
    for i, c in enumerate(item, 1):
        place = low + i + ladder
        inside = (place >= 1) & (place <= len(text))
        same = np.zeros(len(place), bool)
        same[inside] = text[place[inside] - 1] == c
        step = np.minimum(row + ~same, np.r_[row[1:], far] + 1)  # match or replace; leave the item's character out
        step = np.where(inside, step, np.where(place == 0, i, far))
        row = np.minimum.accumulate(step - ladder) + ladder  # characters of the text put in
        row = np.where((place >= 0) & (place <= len(text)), row, far)
    out = np.full(len(text) + 1, far)
    ok = (place >= 0) & (place <= len(text))
    out[place[ok]] = row[ok]
    return out


def _find_batches(items: list[tuple[int, str | None]], q: int, error_rate: float, clean_only: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, q, error_rate)
        for batch in batches:
            found = [before + index.leaks(text.as_py() or "") for text, before in zip(batch.column(1), batch.column(2).to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, LEAK_TYPE)], names=[ROW, "data", "leaks"])
            yield out.filter(pa.array([not f for f in found], pa.bool_())) if clean_only else out

    return run


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = 8 << 20) -> Iterator[list[tuple[int, str | None]]]:
    """The passages in blocks of a bounded number of characters (a block has at least one passage)."""
    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / block_chars))
    dealt = stored(rows.repartition(parts).withColumn("part", F.spark_partition_id()), "passages")
    for part in range(parts):
        yield sorted((r.item_id, r.text) for r in dealt.filter(F.col("part") == part).filter(F.col("text").isNotNull()).toLocalIterator())


def find_leaks(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", q: int = 10, error_rate: float = 0.08,
               clean_only: bool = False, block_chars: int = 8 << 20) -> DataFrame:
    """Columns ``keep`` packed as ``_row``, and leaks: array of (item_id, start, end, edits) of every whole text.

    An item of m characters (normalised) leaks where the text holds it with at most ``int(error_rate * m)`` edits. With ``clean_only``
    only documents without a leak are returned. Null and empty texts have no leak; null or empty items, and
    items without an id, take no part; items shorter than ``q`` must occur without edits. Equal documents get
    equal results; repeated items count once each by id. Empty tables give no leaks. Each block of items is one
    pass over the documents; nothing is shuffled.
    """
    found = with_text(docs, keep, text_col).withColumn("leaks", F.expr("array()").cast(LEAK))
    inner = found.schema[ROW].dataType.simpleString()
    for block in item_blocks(items, block_chars=block_chars):
        found = found.mapInArrow(_find_batches(block, q, error_rate, clean_only), f"{ROW} {inner}, data string, leaks {LEAK}")
    return found.select(ROW, "leaks")
