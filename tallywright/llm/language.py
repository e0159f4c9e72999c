"""Language of a text by interpolated Kneser-Ney models over characters.

Texts are lower-cased; runs of anything but letters become one blank. For every language a model of order four
is estimated from a bounded sample of labelled texts. The models share sorted arrays of 64-bit n-gram hashes:
one row for each n-gram seen in any language, with its log probability in every language, and one for each
history with the languages' back-off weights. The language with the lowest cross-entropy per character wins;
a text whose entropy lies far above that of the language's own texts is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywright.llm.common import ROW, stored, thinned, top_of_label, with_text

ORDER = 4
BLANK = 32
UNKNOWN = "und"
#: Characters that an unseen one is drawn from.
ALPHABET = 1 << 16
#: Variance of one character's surprise (nats squared), for the entropy's spread in short texts.
CHARACTER_VARIANCE = 6.0
#: A language's texts are taken to differ by at least this many nats per character, as a sample of plain texts
#: does not show lists, names or noise; and a text this many deviations out is not rejected yet.
LEAST_SPREAD, LEAST_DISTANCE = 0.25, 6.0


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and where each text begins (one more entry: the end)."""
    joined = "\0".join(t.replace("\0", " ").lower() for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter, stop = _letters()[codes], codes == 0
    after_letter = np.r_[False, letter[:-1]]
    keep = letter | after_letter
    begins = np.r_[0, np.cumsum(keep)[stop]]
    return np.where(letter, codes, BLANK)[keep].astype(np.uint64), begins


def histories(codes: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Columns of the n-grams of length ``ORDER`` that end at each character; blanks before a text."""
    columns = []
    for back in range(ORDER - 1, 0, -1):
        column = np.r_[np.full(back, BLANK, np.uint64), codes[:-back] if back < len(codes) else codes[:0]][: len(codes)]
        for at in range(back):
            first = begins[:-1] + at
            column[first[first < begins[1:]]] = BLANK
        columns.append(column)
    return [*columns, codes]


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of n-grams given by columns."""
    out = np.full(len(columns[0]) if columns else 0, 0x9E3779B97F4A7C15 + len(columns), np.uint64)
    for column in columns:
        out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0x94D049BB133111EB)


class HashArray:
    """Sorted hashes; a directory over their leading bits leads to the place of one."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(8, (2 * len(keys)).bit_length()))
        self.directory = np.searchsorted(keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)
        self.padded = np.r_[keys, np.uint64(0xFFFFFFFFFFFFFFFF)]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is missing."""
        at = self.directory[(wanted >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.padded[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.padded[at[behind]] < wanted[behind]]
        at[(self.padded[at] != wanted) | (at >= len(self.keys))] = -1
        return at


class Model(NamedTuple):
    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted hashes, log probabilities by language
    histories: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted hashes, log back-off weights by language
    entropy: np.ndarray  # by language: mean, deviation between texts
    reject: float
    margin: tuple[float, float]


def _distinct(columns: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (rows) and the sums of their weights."""
    _, first, inverse = np.unique(hashed(list(columns.T)), return_index=True, return_inverse=True)
    return columns[first], np.bincount(inverse, weights, len(first))


def _kneser_ney(grams: np.ndarray, counts: np.ndarray) -> tuple[list, list]:
    """By order from 1: (n-grams, probabilities) and (histories, back-off weights) of one language."""
    by_order = [(grams, counts)]
    for _ in range(ORDER - 1):
        longer = by_order[0][0]
        by_order.insert(0, _distinct(longer[:, 1:], np.ones(len(longer))))
    probabilities, backoffs = [], []
    for order, (rows, seen) in enumerate(by_order, 1):
        ones, twos = (seen == 1).sum(), (seen == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        _, first, inverse = np.unique(hashed(list(rows[:, :-1].T)), return_index=True, return_inverse=True) if order > 1 else (0, np.zeros(1, int), np.zeros(len(rows), int))
        total, types = np.bincount(inverse, seen, len(first)), np.bincount(inverse, minlength=len(first))
        weight = discount * types / total
        if order == 1:
            lower = np.full(len(rows), 1.0 / ALPHABET)
        else:
            short, p = probabilities[-1]
            keys = hashed(list(short.T))
            sort = np.argsort(keys)
            lower = p[sort[np.searchsorted(keys[sort], hashed(list(rows[:, 1:].T)))]]
        probabilities.append((rows, (seen - discount) / total[inverse] + weight[inverse] * lower))
        backoffs.append((rows[first, :-1], weight))
    return probabilities, backoffs


def _together(tables: list[tuple[np.ndarray, np.ndarray]], missing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One table (sorted hashes, n-grams, log values by language); ``missing`` gives the values a language lacks."""
    rows = np.concatenate([t[0] for t in tables])
    keys, first = np.unique(hashed(list(rows.T)) if rows.shape[1] else np.zeros(len(rows), np.uint64), return_index=True)
    values = missing(rows[first])
    for language, (own, value) in enumerate(tables):
        at = np.searchsorted(keys, hashed(list(own.T)) if own.shape[1] else np.zeros(len(own), np.uint64))
        values[at, language] = np.log(value)
    return keys, rows[first], values


def _joined(per_language: list[tuple[list, list]]) -> tuple[list, list]:
    n = len(per_language)
    grams, histories_ = [], []
    for order in range(ORDER):
        weights = _together([backoffs[order] for _, backoffs in per_language], lambda rows: np.zeros((len(rows), n)))
        histories_.append((weights[0], weights[2]))

        def lacking(rows, order=order, weights=weights):
            own = np.searchsorted(weights[0], hashed(list(rows[:, :-1].T))) if order else np.zeros(len(rows), int)
            if order == 0:
                return weights[2][own] - math.log(ALPHABET)
            return weights[2][own] + grams[-1][1][np.searchsorted(grams[-1][0], hashed(list(rows[:, 1:].T)))]

        keys, _, values = _together([probabilities[order] for probabilities, _ in per_language], lacking)
        grams.append((keys, values))
    return grams, histories_


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.grams = [(HashArray(k), v.astype(np.float32)) for k, v in model.grams]
        self.histories = [(HashArray(k), v.astype(np.float32)) for k, v in model.histories]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character by text and language, and the characters of each text."""
        codes, begins = characters(texts)
        sizes = np.diff(begins)
        if not len(codes):
            return np.zeros((len(texts), len(self.model.languages))), sizes
        columns = histories(codes, begins)
        total, todo = np.zeros((len(codes), len(self.model.languages)), np.float32), np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            keys, values = self.grams[order - 1]
            here = [c[todo] for c in columns[ORDER - order :]] if order < ORDER else columns
            at = keys.find(hashed(here))
            found = at >= 0
            if order == ORDER and found.all():
                total = values[at]
                todo = todo[:0]
                break
            total[todo[found]] += values[at[found]]
            todo = todo[~found]
            if not len(todo):
                break
            if order > 1:
                keys, values = self.histories[order - 1]
                at = keys.find(hashed([c[todo] for c in columns[ORDER - order : -1]]))
                total[todo[at >= 0]] += values[at[at >= 0]]
        if len(todo):
            total[todo] += self.histories[0][1][0] - np.float32(math.log(ALPHABET))
        sums = np.add.reduceat(np.vstack([total, np.zeros((1, total.shape[1]), np.float32)]), np.minimum(begins[:-1], len(codes)), axis=0, dtype=np.float64)
        sums[sizes == 0] = 0
        return -sums / np.maximum(sizes, 1)[:, None], sizes

    def decide(self, texts: list[str]) -> list[tuple[str, float, bool, float | None]]:
        """(language, score, rejected, entropy) of each text."""
        out = []
        if not self.model.languages:
            return [(UNKNOWN, 0.0, True, None)] * len(texts)
        h, sizes = self.entropies(texts)
        best = h.argmin(axis=1)
        for i, (b, n) in enumerate(zip(best.tolist(), sizes.tolist())):
            if not n:
                out.append((UNKNOWN, 0.0, True, None))
                continue
            a, w = self.model.margin
            score = 1 / (1 + math.exp(-min(max(a + w * margin(h[i], n), -30.0), 30.0)))
            out.append((self.model.languages[b], score, bool(distance(self.model.entropy, b, h[i, b], n) > self.model.reject), float(h[i, b])))
        return out


def margin(entropies: np.ndarray, size: int) -> float:
    """Distance of the two lowest entropies, larger for longer texts."""
    if len(entropies) < 2:
        return 20.0
    low, second = np.partition(entropies, 1)[:2]
    return float(second - low) * math.sqrt(min(size, 10_000))


def distance(entropy: np.ndarray, language: int, value: float, size: int) -> float:
    """Deviations by which a text's entropy lies above its language's mean."""
    mean, spread = entropy[language]
    return (value - mean) / math.sqrt(spread * spread + CHARACTER_VARIANCE / size)


def _count_batches(lang: tuple, rows: pa.Table) -> pa.Table:
    codes, begins = characters([t or "" for t in rows["text"].to_pylist()])
    grams, counts = _distinct(np.stack(histories(codes, begins), axis=1), np.ones(len(codes))) if len(codes) else (np.zeros((0, ORDER), np.uint64), np.zeros(0))
    return pa.table({"lang": pa.array([lang[0].as_py()], pa.string()), "grams": pa.array([grams.astype("<u4").tobytes()], pa.binary()), "counts": pa.array([counts.astype("<f8").tobytes()], pa.binary())})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600) -> Model:
    """Fit on a bounded sample: of each language the ``per_language`` rows whose hashed id comes first, whole texts.

    Two rows of three give the counts, taken language by language in tasks; the third calibrates the score and
    the rejection. Rows with a null text or language are left out. Without any the model rejects everything.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = top_of_label(thinned(rows, "lang", "id", per_language, 7).withColumn("h", F.xxhash64("text")), "lang", ["draw", "h"], per_language)
    sample = stored(picked.select("lang", "n", "text"), "languages")
    counted = sample.filter("n % 3 != 0 OR n < 3").groupBy("lang").applyInArrow(_count_batches, "lang string, grams binary, counts binary")
    tables = {}
    for r in stored(counted, "counts").toLocalIterator():
        grams = np.frombuffer(r.grams, "<u4").reshape(-1, ORDER).astype(np.uint64)
        if len(grams):
            tables[r.lang] = _kneser_ney(grams, np.frombuffer(r.counts, "<f8"))
    names = sorted(tables)
    if not names:
        return Model([], [], [], np.zeros((0, 2)), 0.0, (0.0, 0.0))
    grams, histories_ = _joined([tables[n] for n in names])
    model = Model(names, grams, histories_, np.tile([3.0, 1.0], (len(names), 1)), math.inf, (0.0, 1.0))
    tests = [(r.lang, r.text) for r in sample.filter("n % 3 = 0 OR n < 3").toLocalIterator() if r.lang in tables]
    return _calibrated(model, sorted(tests))


def _calibrated(model: Model, tests: list[tuple[str, str]]) -> Model:
    place = {name: i for i, name in enumerate(model.languages)}
    h, sizes = Scorer(model).entropies([t for _, t in tests])
    own, ok = np.array([place[lang] for lang, _ in tests], dtype=int), sizes > 0
    h, sizes, own = h[ok], sizes[ok], own[ok]
    if not len(own):
        return model
    right = h.argmin(axis=1) == own
    entropy = model.entropy.copy()
    for i in range(len(model.languages)):
        mine = h[(own == i) & right & (sizes >= 50), i]
        if len(mine):
            entropy[i] = mine.mean(), max(mine.std(), LEAST_SPREAD)
    far = [distance(entropy, o, h[i, o], n) for i, (o, n) in enumerate(zip(own.tolist(), sizes.tolist())) if right[i]]
    x = np.array([margin(row, n) for row, n in zip(h, sizes.tolist())])
    x = np.stack([np.ones(len(x)), np.minimum(x, 50)], axis=1)
    y = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))  # no certainty from a sample
    w = prior = np.array([0.0, 0.5])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), x.T @ (y - p) - 0.1 * (w - prior))
        step = step / max(1.0, np.abs(step).max())
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return model._replace(entropy=entropy, reject=max(LEAST_DISTANCE, 1.5 * max(far, default=0.0)), margin=(float(w[0]), float(max(w[1], 0.0))))


def _identify_batches(model: Model, most: int = 300_000):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found, texts, size = [], [], 0
            for value in batch.column(1):
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size >= most:
                    found += scorer.decide(texts)
                    texts, size = [], 0
            found += scorer.decide(texts) if texts else []
            columns = zip(*found) if found else ([], [], [], [])
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
                                             names=[ROW, "lang_pred", "score", "rejected", "entropy"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` packed as ``_row``, then lang_pred, score, rejected and entropy of every whole text.

    Null and empty texts and texts without a letter are ``und`` with score 0 and rejected. Ties go to the first
    language by name. Equal texts get equal results; an empty table gives an empty result.
    """
    packed = with_text(docs, keep, text_col)
    inner = packed.schema[ROW].dataType.simpleString()
    return packed.mapInArrow(_identify_batches(model), f"{ROW} {inner}, lang_pred string, score double, rejected boolean, entropy double")
