"""Wavelet matrix of one shard of token ids, as one compressed file.

The ids are stored as bit planes from the highest bit down. After each plane the ids are put in the order of
their bit, zeros first, both halves in their old order. ``access``, ``rank`` and ``select`` walk the planes;
a directory of ones before each block of 512 bits makes a step a few operations.

File (little endian): magic ``WVM1``, then five unsigned 64-bit numbers: documents, ids, planes, bytes of the
document table, bytes of the planes. The document table (Zstandard): for each document a byte telling
whether its id is not null, then all ids as 64-bit numbers, then the lengths as 64-bit numbers. The planes
(Zstandard): for each plane the packed bits, first bit highest, padded to bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WVM1"
HEAD = struct.Struct("<4s5Q")
BLOCK = 512


class WaveletMatrix:
    def __init__(self, planes: list[np.ndarray], length: int):
        self.planes, self.length = planes, length
        self.zeros = [length - int(np.bitwise_count(p).sum(dtype=np.int64)) for p in planes]
        self._counts: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids)
        width = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes = []
        for level in range(width - 1, -1, -1):
            bit = (now & now.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(bit))
            if level:
                now = np.concatenate([np.compress(~bit, now), np.compress(bit, now)])
        return cls(planes, len(ids))

    def bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.length).view(bool)

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest bit up."""
        width = len(self.planes)
        now = np.zeros(self.length, np.uint16 if width <= 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            bit, back = self.bits(level), np.empty_like(now)
            back[np.flatnonzero(~bit)] = now[: self.zeros[level]]
            back[np.flatnonzero(bit)] = now[self.zeros[level] :] | now.dtype.type(1 << (width - 1 - level))
            now = back
        return now

    def _ones(self, level: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        if self._counts is None:
            step = BLOCK // 8
            self._counts = [
                np.r_[0, np.cumsum(np.add.reduceat(np.bitwise_count(p), np.arange(0, len(p), step), dtype=np.int64))] if len(p) else np.zeros(1, np.int64)
                for p in self.planes]
        block = at // BLOCK
        a, b = block * BLOCK // 8, at // 8
        plane = self.planes[level]
        ones = int(self._counts[level][block]) + int(np.bitwise_count(plane[a:b]).sum(dtype=np.int64))
        return ones + ((int(plane[b]) >> (8 - at % 8)).bit_count() if at % 8 else 0)

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.length:
            raise IndexError(at)
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][at // 8]) >> (7 - at % 8) & 1
            ones = self._ones(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where ``value`` among the first ``end`` ids lies below the last plane."""
        low, high = 0, end
        for level in range(len(self.planes)):
            a, b = self._ones(level, low), self._ones(level, high)
            if value >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, value: int, end: int) -> int:
        """Occurrences of an id before position ``end``."""
        if value < 0 or value >> len(self.planes) or self.length == 0:
            return 0
        low, high = self._range(value, max(0, min(end, self.length)))
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.length)

    def select(self, value: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of an id; -1 where there are fewer."""
        if not 0 <= nth < self.count(value):
            return -1
        at = self._range(value, 0)[0] + nth
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _place(self, level: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) one or zero of a plane, by halving."""
        low, high = 0, self.length
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > nth:
                high = mid
            else:
                low = mid + 1
        return low

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, n) for n in range(self.count(value))]


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, level: int = 1) -> bytes:
    """The bytes of a file. ``lengths`` are the ids of each document, in order."""
    matrix = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    named = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    press = zstandard.ZstdCompressor(level=level)
    docs = press.compress(known + named + np.array(lengths, "<i8").tobytes())
    planes = press.compress(b"".join(p.tobytes() for p in matrix.planes))
    return HEAD.pack(MAGIC, len(doc_ids), len(ids), len(matrix.planes), len(docs), len(planes)) + docs + planes


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths and the matrix of a file."""
    magic, docs, length, planes, doc_bytes, plane_bytes = HEAD.unpack_from(data)
    if magic != MAGIC or len(data) != HEAD.size + doc_bytes + plane_bytes:
        raise ValueError("not a whole wavelet file")
    press = zstandard.ZstdDecompressor()
    head = press.decompress(data[HEAD.size : HEAD.size + doc_bytes])
    known = head[:docs]
    named = np.frombuffer(head, "<i8", docs, docs).tolist()
    lengths = np.frombuffer(head, "<i8", docs, docs + 8 * docs)
    body, step = press.decompress(data[HEAD.size + doc_bytes :]), (length + 7) // 8
    parts = [np.frombuffer(body, np.uint8, step, step * p) for p in range(planes)]
    return [d if k else None for d, k in zip(named, known)], lengths, WaveletMatrix(parts, length)
