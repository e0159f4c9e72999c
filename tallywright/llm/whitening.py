"""Whitening of vectors by eigenvectors that are found in single precision and refined in extended precision.

Vectors are whole numbers here (scaled and shifted by the caller), so sums and centred products are added up exactly.
The eigenvectors of the covariance come from a float32 solver; steps of matrix products in extended precision (Ogita
and Aishima) then double their correct digits each time. Columns whose eigenvalues are too close for such a step are
turned into each other by the solution of the small problem in the space that they span.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WIDE = np.longdouble
#: Vectors with larger entries take no part: sums of their products leave the range in which they are exact.
LARGEST = 1 << 31


def whole_numbers(vector: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """floor(scale * entry) + shift of every entry; null if the vector is null or has a null, non-finite or very large entry."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    limit = float(LARGEST // scale)
    good = F.forall(entries, lambda c: F.coalesce(c.between(-limit, limit), F.lit(False)))
    return F.when(good, F.transform(entries, lambda c: F.floor(F.lit(float(scale)) * c) + shift))


def common_length(rows: DataFrame) -> int:
    """The most frequent length of ``x`` over zero (the larger in a tie); 0 without vectors."""
    sizes = rows.groupBy(F.size("x").alias("d")).count().filter("d > 0")
    found = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return int(found["d"]) if found else 0


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(-1, d)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _sums(d: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, "i8")
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, total = n + len(x), total + x.sum(0)
        if n:
            yield _batch(i=np.arange(d, dtype="i4"), n=np.full(d, n, "i8"), s=total)

    return run


def _products(d: int, centre: np.ndarray):
    upper = np.triu_indices(d)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d), object), False
        for batch in batches:
            x = _matrix(batch.column(0), d) - centre
            most = int(np.abs(x).max(initial=0)) ** 2
            step = max(1, (1 << 53) // max(most, 1))  # products of so many rows add up exactly in doubles
            for a in range(0, len(x), step) if most < 1 << 53 else ():
                y, seen = x[a : a + step].astype("f8"), True
                total = total + (y.T @ y).astype("i8")
            if most >= 1 << 53 and len(x):
                y, seen = x.astype(object), True
                total = total + y.T @ y
        if seen:
            yield pa.RecordBatch.from_pydict({"i": pa.array(upper[0].astype("i4")), "j": pa.array(upper[1].astype("i4")),
                                              "v": pa.array([str(v) for v in total[upper]], pa.string())})

    return run


def exact_covariance(rows: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, exact sum of each dimension, and the covariance (divisor n) in extended precision.

    Each task adds up its own rows and passes on d sums, and then d (d + 1) / 2 sums of products of entries from
    which the rounded mean has been taken; Spark adds these by position, as decimals.
    """
    sums = rows.select("x").mapInArrow(_sums(d), "i int, n bigint, s bigint")
    found = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    n, totals = int(found[0]["n"]), [int(r["s"]) for r in found]
    centre = np.array([(2 * s + n) // (2 * n) for s in totals], "i8")
    parts = rows.select("x").mapInArrow(_products(d, centre), "i int, j int, v string")
    cells = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    rest = [s - n * int(c) for s, c in zip(totals, centre)]  # what the rounded mean leaves
    v = np.zeros((d, d), WIDE)
    for cell in cells:
        i, j = cell["i"], cell["j"]
        exact = n * int(cell["v"]) - rest[i] * rest[j]  # n * n * covariance, a whole number
        whole, part = divmod(exact, n * n)
        v[i, j] = v[j, i] = WIDE(str(whole)) + WIDE(part) / WIDE(n) / WIDE(n)
    return n, totals, v


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One refinement of all columns; the eigenvalues and the largest correction."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    close = 2 * (np.linalg.norm(off.astype("f8")) + np.abs(values).max() * np.linalg.norm(r.astype("f8")))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > close
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, float(np.abs(e).max())


def _orthonormal(x: np.ndarray, steps: int = 2) -> np.ndarray:
    """Unit columns at right angles again, without mixing close columns by their gap."""
    for _ in range(steps):
        x = x + x @ (np.eye(len(x), dtype=WIDE) - x.T @ x) / 2
    return x


def _clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > close) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined_eigenvectors(a: np.ndarray, steps: int = 12, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix of extended precision.

    Starts from a float32 solution. After the steps have settled, the columns of each cluster of close eigenvalues
    are an orthonormal basis of the right space; in it the matrix, less the cluster's mean value, is small and gets
    a float32 solution and steps of its own. Equal eigenvalues keep any basis of their space.
    """
    a = np.asarray(a, WIDE)
    size = np.abs(a).max(initial=0)
    if len(a) == 1 or not size:
        return np.diag(a).copy(), np.eye(len(a), dtype=WIDE)
    b = a / size
    x = np.linalg.eigh(b.astype("f4"))[1].astype(WIDE)
    floor = 64 * len(a) * float(np.finfo(WIDE).eps)
    last = np.inf
    for _ in range(steps):
        x, values, change = _step(b, x)
        if change <= floor or change > last / 2 and last < 1e-12:
            break
        last = change
    x = _orthonormal(x)
    if depth < 4:
        turned = False
        for own in _clusters(values, 1e-4 * float(np.abs(values).max())):
            q = x[:, own]
            middle = values[own].mean()
            small = q.T @ (b @ q - middle * q)
            small = (small + small.T) / 2
            if np.abs(small - np.diag(np.diag(small))).max() <= floor * 1e-3:
                continue
            x[:, own] = q @ refined_eigenvectors(small, steps, depth + 1)[1]
            turned = True
        x = _orthonormal(x) if turned else x
    values = np.einsum("ij,ij->j", x, b @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


@dataclass
class Whitening:
    """What whitening needs: rows, sums, eigenvalues (falling) and eigenvectors of the fit list, and the share of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def d(self) -> int:
        return len(self.sums)


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """Mean and leading components of ``x`` (array of long, no null within) over all rows of the most frequent length.

    None without any vector. A component without variance has eigenvalue 0.
    """
    rows = rows.filter("x IS NOT NULL")
    d = common_length(rows)
    if not d:
        return None
    n, sums, v = exact_covariance(rows.filter(F.size("x") == d), d)
    values, vectors = refined_eigenvectors(v)
    trace = np.trace(v)
    k = min(components, d)
    values = np.where(values[:k] > trace * WIDE(1e-16), values[:k], 0)
    return Whitening(n, sums, values, vectors[:, :k], values / (trace if trace > 0 else WIDE(1)))


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows; NaN where a component has no variance."""
    centre = np.array([s // model.n for s in model.sums], "i8")
    rest = np.array([WIDE(s % model.n) / WIDE(model.n) for s in model.sums], WIDE)
    scale = np.where(model.values > 0, model.vectors / np.sqrt(np.where(model.values > 0, model.values, 1)), np.nan).astype("f8")
    return ((x - centre) - rest.astype("f8")) @ scale


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S) squared, exact; None where it isn't a long."""
    centre = np.array([s // model.n for s in model.sums], object)
    rest = [s % model.n for s in model.sums]
    y = x - centre.astype("i8")
    most = model.n * (int(np.abs(y).max(initial=0)) + 1)
    if most * most * model.d < 1 << 63:
        z = y * model.n - np.array(rest, "i8")
        return (z * z).sum(1).tolist()
    z = y.astype(object) * model.n - np.array(rest, object)
    return [v if v < 1 << 63 else None for v in (z * z).sum(1)]


def _moments(model: Whitening):
    k = model.vectors.shape[1]
    upper = np.triu_indices(k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _projected(_matrix(batch.column(0), model.d), model)
            if len(w):
                mean = w.mean(0)
                m2 = (w - mean).T @ (w - mean)
                yield _batch(i=upper[0].astype("i4"), j=upper[1].astype("i4"), n=np.full(len(upper[0]), len(w), "i8"),
                             a=mean[upper[0]], b=mean[upper[1]], m=m2[upper])

    return run


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance less the identity, by size; components without variance are left out.

    Each block of rows passes on its centred products and its means; how the means differ is added from their own products.
    """
    parts = rows.filter(F.size("x") == model.d).select("x").mapInArrow(_moments(model), "i int, j int, n bigint, a double, b double, m double")
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    found = parts.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(n * a * b).alias("ab"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b")).collect()
    errors = [abs(r["m"] / r["n"] + (r["ab"] - r["a"] * r["b"] / r["n"]) / r["n"] - (r["i"] == r["j"])) for r in found
              if model.values[r["i"]] > 0 and model.values[r["j"]] > 0]
    return max(errors, default=0.0)


def _whitened(model: Whitening, key: str):
    k = model.vectors.shape[1]
    explained = model.explained.astype("f8")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), model.d)
            if not len(x):
                continue
            w, each = _projected(x, model), np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(x))),
                 pa.array(deviations(x, model), pa.int64()).take(pa.array(each)), pa.array(w.ravel(), from_pandas=True),
                 pa.array(np.tile(explained, len(x)))], names=[key, "component", "deviation", "whitened", "explained"])

    return run


def whiten(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained) of every row of the fit's length and every component.

    ``rows`` has the id (any type, null too) and ``x``; rows whose ``x`` is null or of another length take no part, repeated rows
    are kept, other columns are not carried. ``whitened`` is null where the component has no variance (one row, or all rows alike).
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, deviation bigint, whitened double, explained double"
    if model is None:
        out = rows.sparkSession.createDataFrame([], schema).withColumn("n", F.lit(0).cast("bigint"))
    else:
        own = rows.filter(F.size("x") == model.d).select(id_col, "x")
        out = own.mapInArrow(_whitened(model, id_col), schema).withColumn("n", F.lit(model.n).cast("bigint"))
    return out.select(id_col, "component", "n", "deviation", "whitened", "explained")
