"""Shards of nearly equal bytes: sampled splitters, range partitioning, and finer splitters where a range is too full.

Rows are ordered by (hash of text, hash of id, place in the input), so equal texts lie side by side. Splitters are
quantiles of a size-weighted sample of these keys; they cut the order into many more ranges than shards. Exact
counts of the ranges show which are too full (one text may hold a third of all rows), and these get splitters from
a sample of their own until none is. A shard is a run of whole ranges and of parts of the two at its ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallywright.functions.tables import broadcast_if_small
from tallywright.llm.common import new_folder, run_parts, stored

KEY = ["_g", "_d", "_t"]
RANGES_A_SHARD = 128
SAMPLES_A_RANGE = 32
#: A range of more rows is cut further, whatever its bytes, so that sorting one stays a small job.
RANGE_ROWS = 1 << 22


@dataclass
class Plan:
    """Splitters (first key of each range but the first), rows before each range, write task of each range, first row of each shard but the first."""

    splitters: np.ndarray
    before: np.ndarray
    part: np.ndarray
    cuts: list[int]
    parts: int


def encoded(g: np.ndarray, d: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Three longs as 24 bytes that sort as the longs do."""
    out = np.empty((len(g), 3), ">u8")
    for i, column in enumerate((g, d, t)):
        out[:, i] = np.asarray(column, "i8").view("u8") ^ np.uint64(1 << 63)
    return np.ascontiguousarray(out).view("S24").ravel()


def _key_columns(id_col: str, text_col: str) -> dict[str, Column]:
    return {"_g": F.xxhash64(f"`{text_col}`"), "_d": F.xxhash64(f"`{id_col}`"), "_t": F.monotonically_increasing_id()}


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text and one more; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _range_of(splitters: np.ndarray):
    @F.pandas_udf("int")
    def found(g: pd.Series, d: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, encoded(g.to_numpy(), d.to_numpy(), t.to_numpy()), side="right").astype("i4"))

    return found(*KEY)


def _quantiles(sample: pd.DataFrame, pieces: int) -> np.ndarray:
    """Keys that cut a weighted sample into ``pieces`` parts of equal weight."""
    keys, weight = encoded(*(sample[c] for c in KEY)), sample["w"].to_numpy("f8")
    order = np.argsort(keys, kind="stable")
    reached = np.cumsum(weight[order])
    at = np.searchsorted(reached, reached[-1] * np.arange(1, pieces) / pieces) if len(order) else []
    return keys[order][at] if len(order) else keys


def _sampled(rows: DataFrame, share: Column, seed: int) -> pd.DataFrame:
    """Rows drawn with probability ``share`` (one at most) by a hash of their key, each with the weight it stands for."""
    draw = F.xxhash64(F.lit(seed), *KEY) / F.lit(2.0**64) + 0.5
    return rows.select(*KEY, share.alias("w")).filter(draw < F.col("w")).withColumn("w", F.greatest("w", F.lit(1.0))).toPandas()


def _counted(rows: DataFrame, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, bytes and least group hash of every range."""
    found = rows.groupBy(_range_of(splitters).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min("_g").alias("g")).toPandas()
    n, b, g = (np.zeros(len(splitters) + 1, "i8") for _ in range(3))
    n[found["r"]], b[found["r"]], g[found["r"]] = found["n"], found["b"], found["g"]
    return n, b, g


def _cut_rows(rows: DataFrame, splitters: np.ndarray, n: np.ndarray, b: np.ndarray, g: np.ndarray, shards: int, slack: float) -> list[int]:
    """Rows before each shard but the first: where the bytes before are nearest to the shard's share.

    A place between two different texts is taken first if it is within ``slack`` of a share, so copies stay
    together where that costs no balance. Only the ranges about the shares are read.
    """
    total, ends = int(b.sum()), np.cumsum(b)
    near, wanted = total / shards * slack, []
    for i in range(1, shards):
        target = total * i / shards
        a, z = np.searchsorted(ends, target - near), np.searchsorted(ends, target + near)
        wanted += [(r, i, target, int(ends[r] - b[r]), int(n[:r].sum()), int(g[r + 1]) if r + 1 < len(g) else None)
                   for r in range(max(0, a - 1), min(len(b) - 1, z) + 1) if n[r]]
    spark = rows.sparkSession
    asked = spark.createDataFrame(wanted, "r int, shard int, target double, bytes_before bigint, rows_before bigint, next_g bigint")
    own = rows.withColumn("r", _range_of(splitters)).filter(F.col("r").isin(sorted({w[0] for w in wanted})))
    inside = W.partitionBy("r").orderBy(*KEY)
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    walked = own.select("r", "_g", F.sum("size").over(so_far).alias("b"), F.row_number().over(inside).alias("n"), F.lead("_g").over(inside).alias("after"))
    each = walked.join(F.broadcast(asked), "r").withColumns({
        "off": F.abs(F.col("bytes_before") + F.col("b") - F.col("target")),
        "at": F.col("rows_before") + F.col("n"),
        "border": ~F.coalesce("after", "next_g").eqNullSafe(F.col("_g"))})
    free = ~(F.col("border") & (F.col("off") <= near))
    best = each.groupBy("shard").agg(F.min(F.struct(free, "off", "at"))["at"].alias("at")).toPandas().set_index("shard")["at"]
    found = [int(best.get(i, 0)) for i in range(1, shards)]
    return [int(x) for x in np.maximum.accumulate(found)] if found else []


def plan(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.005,
         ranges_a_shard: int = RANGES_A_SHARD, range_rows: int = RANGE_ROWS, parts: int | None = None) -> Plan:
    """Splitters and shard borders of ``docs``, found from a table of keys and sizes (32 bytes a row) on the shared folder.

    The driver holds the ranges and their samples: as many as ``shards * ranges_a_shard``, or one for about every
    ``range_rows`` rows where that is more.
    """
    rows = stored(docs.select(*[c.alias(k) for k, c in _key_columns(id_col, text_col).items()], size_of(F.col(f"`{text_col}`")).alias("size")), "shard-keys")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    parts, base = parts or run_parts(docs), shards * ranges_a_shard
    if not total["n"]:
        return Plan(encoded([], [], []), np.zeros(1, "i8"), np.zeros(1, "i4"), [0] * (shards - 1), parts)
    most_rows, most_bytes = max(1, min(4 * total["n"] / base, range_rows)), 4 * total["b"] / base
    first = _sampled(rows, F.col("size") * (base * SAMPLES_A_RANGE / total["b"]), 0)
    splitters, seed = np.unique(_quantiles(first, base)), 0
    while True:
        n, b, g = _counted(rows, splitters)
        full = np.flatnonzero((n > 1) & ((n > most_rows) | (b > most_bytes)))
        lone = b[full] > most_bytes  # one long text may fill a range; then only its row is left in it
        if not len(full) or seed > 40 and not (n[full] > most_rows).any() and lone.all():
            break
        seed += 1
        pieces = {int(r): 2 * math.ceil(max(n[r] / most_rows, b[r] / most_bytes)) for r in full}
        spark = rows.sparkSession
        asked = spark.createDataFrame(
            [(r, 0.5 * SAMPLES_A_RANGE * k / float(b[r]), 0.5 * SAMPLES_A_RANGE * k / float(n[r])) for r, k in pieces.items()], "r int, by_byte double, by_row double")
        inside = rows.withColumn("r", _range_of(splitters)).join(broadcast_if_small(asked), "r")
        drawn = _sampled(inside, F.col("size") * F.col("by_byte") + F.col("by_row"), seed)
        at = np.searchsorted(splitters, encoded(*(drawn[c] for c in KEY)), side="right")
        splitters = np.unique(np.concatenate([splitters, *[_quantiles(drawn[at == r], k) for r, k in pieces.items()]]))
    cuts = _cut_rows(rows, splitters, n, b, g, shards, slack) if shards > 1 else []
    weight = n / n.sum() + b / b.sum()
    part = np.minimum((np.cumsum(weight) - weight) / 2 * parts, parts - 1).astype("i4")
    return Plan(splitters, np.cumsum(n) - n, part, cuts, parts)


def free_names(columns: list[str], wanted: list[str]) -> list[str]:
    """``wanted`` names, each with underscores behind it until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def assign(docs: DataFrame, found: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``shard`` and ``slot`` (its number in the shard, from 0), range-partitioned by the plan's splitters.

    The two columns get underscores behind their names where ``docs`` has columns of these names.
    """
    splitters, before, part = found.splitters, found.before, found.part

    @F.pandas_udf("part int, r int, before bigint")
    def placed(g: pd.Series, d: pd.Series, t: pd.Series) -> pd.DataFrame:
        r = np.searchsorted(splitters, encoded(g.to_numpy(), d.to_numpy(), t.to_numpy()), side="right")
        return pd.DataFrame({"part": part[r], "r": r.astype("i4"), "before": before[r]})

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, *[c.alias(k) for k, c in _key_columns(id_col, text_col).items()]).withColumn("_at", placed(*KEY))
    rows = rows.select("_row", *KEY, "_at.part", "_at.r", "_at.before").repartitionById(found.parts, "part")
    order = W.partitionBy("part", "r").orderBy(*KEY)
    numbered = rows.withColumn("_n", F.col("before") + F.row_number().over(order) - 1)
    starts = F.array(*[F.lit(c).cast("bigint") for c in [0, *found.cuts]])
    shard = F.size(F.filter(starts, lambda c: c <= F.col("_n"))) - 1
    names = free_names(docs.columns, ["shard", "slot"])
    placed_rows = numbered.withColumn("_s", shard)
    return placed_rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns], F.col("_s").alias(names[0]),
                              (F.col("_n") - F.element_at(starts, F.col("_s") + 1)).alias(names[1]))


def write_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, **options) -> DataFrame:
    """Write all rows to ``folder/shard=0 ..`` as Parquet, with ``slot`` beside their columns, and read the files back.

    Law "bytes": shards are nearly equal in bytes of text (plus one a row). A border lies between two rows, so a
    shard can be off its share by half a row at each end, and by ``slack`` of a share more where this keeps copies
    of a text together. Null and empty texts have size 1; null ids and rows repeated as a whole are placed like any
    other; an empty table gives empty shards; other columns are carried along, also ones named shard or slot. Rows
    equal in id and text are told apart by their place in the input, so ``docs`` must be a table that reads alike
    twice (files, or a stored result).
    """
    folder = folder or new_folder(docs.sparkSession, "shards")
    placed = assign(docs, plan(docs, shards, id_col, text_col, **options), id_col, text_col)
    shard = free_names(docs.columns, ["shard"])[0]
    placed.write.partitionBy(shard).parquet(folder)
    return docs.sparkSession.read.schema(placed.schema).parquet(folder)
