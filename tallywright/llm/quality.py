"""Quality scores from compression: which of two dictionaries makes a text smaller.

Zstandard dictionaries are built from texts labelled good and bad. A text is compressed with either; the
difference of the sizes over their sum is the evidence. A logistic curve over it and its size, fitted on
labelled texts that built no dictionary, turns it into the chance of a good text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallywright.llm.common import ROW, stored, thinned, top_of_label, with_text


class Model(NamedTuple):
    """Dictionaries by label, the level of compression and the curve's weights."""

    good: bytes
    bad: bytes
    level: int
    weights: tuple[float, ...]


class Compressors:
    def __init__(self, model: Model):
        self.sides = [self._one(d, model.level) for d in (model.good, model.bad)]

    @staticmethod
    def _one(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data is not None:
            data.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, text: bytes) -> tuple[float, float, float]:
        """Normalised difference (above 0: closer to the good texts), joint compression ratio, log size."""
        good, bad = (len(side.compress(text)) for side in self.sides)
        size = len(text)
        return (bad - good) / (bad + good), (good + bad) / (2.0 * size + 40.0), math.log1p(size)


def _design(rows: Iterable[tuple[float, float, float]]) -> np.ndarray:
    """The difference, its square and its interplay with the ratio and the size."""
    x = np.array(list(rows), dtype=float).reshape(-1, 3)
    d, r, n = 10 * x[:, 0], x[:, 1], x[:, 2] / 10
    return np.stack([np.ones(len(x)), d, d * n, d * np.abs(d), r, n, r * r, r * n], axis=1)


def fit_curve(rows: list[tuple[float, float, float]], labels: list[int], ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x, y = _design(rows), np.array(labels, dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (y - p) - ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def chance(model: Model, rows: list[tuple[float, float, float]]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(rows) @ np.array(model.weights), -35, 35)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the plain texts where there are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_label: int = 1500, dictionary_bytes: int = 64 << 10, piece_bytes: int = 4 << 10, level: int = 3) -> Model:
    """Fit on a bounded sample of labelled rows: the ``per_label`` rows of each label whose hashed id comes first.

    Whole texts are used; for the dictionaries they are cut into pieces of ``piece_bytes``. Half of a label's
    rows build its dictionary, the other half the curve. Rows with a null label or text are left out. Without
    any labelled rows every score is 0.5; with one label only it is that label's side of 0.5. Ids are chosen
    before texts are read, so no text but the sample's is moved.
    """
    named = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    present = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"))
    ids = stored(thinned(named.join(present, "id"), "label", "id", per_label, 5).distinct(), "labelled-ids")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    picked = top_of_label(texts.join(ids, "id").withColumn("h", F.xxhash64("text")), "label", ["draw", "h"], per_label)
    rows = sorted((r.label, r.n, r.text.encode("utf-8", "replace")) for r in stored(picked.select("label", "n", "text"), "labelled").toLocalIterator())
    pieces = {0: [], 1: []}
    for label, n, text in rows:
        if n % 2:
            pieces[label] += [text[a : a + piece_bytes] for a in range(0, len(text), piece_bytes)]
    model = Model(_dictionary(pieces[1], dictionary_bytes), _dictionary(pieces[0], dictionary_bytes), level, (0.0,) * 8)
    tests = [(label, text) for label, n, text in rows if n % 2 == 0]
    if not tests:
        return model
    compressors = Compressors(model)
    return model._replace(weights=fit_curve([compressors.features(t) for _, t in tests], [label for label, _ in tests]))


def _score_batches(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(model)
        for batch in batches:
            rows = [compressors.features(v.as_py() or b"") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array(chance(model, rows), pa.float64())], names=[ROW, "difference", "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` packed as ``_row``, the normalised size difference and the score of every whole text.

    Null and empty texts get the score of an empty text. Equal texts get equal scores. Labels, ids and other
    columns play no part. An empty table gives an empty result.
    """
    packed = with_text(docs, keep, text_col).withColumn("data", F.col("data").cast("binary"))
    inner = packed.schema[ROW].dataType.simpleString()
    return packed.mapInArrow(_score_batches(model), f"{ROW} {inner}, difference double, score double")
