"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words; a document of the source gets ``target / source size`` copies on
average. The whole part is certain. The fractional parts are rounded together: two fractional documents
exchange mass (probability times size) at random until one of them is whole, which keeps the words of the
pair and the chance of each document. Buckets of a source are rounded side by side; each leaves at most one
fractional document, and those residuals are rounded again in a tree until one per source is left, which a
seeded draw decides. So a source's words miss its target by less than the size of one document.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallywright.llm.common import ROW, columns_of, row_struct, stored

WORD = r"[^\x20\x09-\x0D]+"
EPSILON = 1e-12


def text_size(column):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0,
                   bucket_rows: int = 2048) -> DataFrame:
    """Targets of sources from a table (source, size): one row per source.

    Sources are ordered by code point, null last, and get the weights in turn. ``share`` times all words are
    dealt out by weight; a target stops at ``cap`` times its source's size and the excess goes to the others
    by weight until none is above. That is the level ``lambda`` with ``target = min(cap * size, lambda *
    weight)``, raised until it stands; only its sums reach the driver.
    """
    if share > cap:
        raise ValueError("share must not be above cap: the words can't be placed")
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    deal = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(found.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", deal), "sources")
    most = F.col("source_size") * float(cap)
    total = ranked.agg((F.sum("source_size") * float(share)).alias("t"), F.sum("weight").alias("w")).first()
    level = (total.t or 0.0) / total.w if total.w else 0.0
    while True:
        full = F.lit(level) * F.col("weight") >= most
        now = ranked.agg(F.sum(F.when(full, most)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        raised = (total.t - (now.fixed or 0.0)) / now.open if now.open else level
        if raised <= level * (1 + 1e-15):
            break
        level = raised
    target = F.least(most, F.lit(level) * F.col("weight"))
    copies = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    return ranked.withColumn("target", target).withColumn("ratio", copies).withColumn(
        "buckets", F.ceil(F.col("docs") / bucket_rows).cast("bigint"))


def pair(size_a: int, p_a: float, size_b: int, p_b: float, draw: float) -> tuple[float, float]:
    """New probabilities of two fractional items: mass moves until one is whole; each keeps its mean."""
    up = min((1 - p_a) * size_a, p_b * size_b)
    down = min((1 - p_b) * size_b, p_a * size_a)
    if draw * (up + down) < down:
        p_a, p_b = p_a + up / size_a, p_b - up / size_b
    else:
        p_a, p_b = p_a - down / size_a, p_b + down / size_b
    return _snap(p_a), _snap(p_b)


def _snap(p: float) -> float:
    return 0.0 if p < EPSILON else 1.0 if p > 1 - EPSILON else p


def _generator(*parts) -> random.Random:
    return random.Random(hashlib.sha256(repr(parts).encode()).digest())


def _round_runs(seed: int, level: int, last: bool):
    """Rounds runs of rows with equal (rank, group), sorted; a row that stays fractional keeps its ``p``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = draws = held = None  # held: (its batch of one row, size, p)

        def emit(batch, values):
            at = batch.schema.get_field_index("p")
            return batch.set_column(at, batch.schema.field(at), pa.array(values, pa.float64()))

        def close(item):
            if last and item[2] not in (0.0, 1.0):
                item = (item[0], item[1], 1.0 if draws.random() < item[2] else 0.0)
            return emit(item[0], [item[2]])

        for batch in batches:
            ranks, groups, sizes, ps = columns_of(batch, "rank", "grp", "size", "p")
            here, before = None, len(ps)  # here: position of the held row if it is in this batch
            for i in range(before):
                if key != (ranks[i], groups[i]):
                    if held is not None:
                        yield close(held)
                    elif here is not None and last:
                        ps[here] = 1.0 if draws.random() < ps[here] else 0.0
                    key, held, here = (ranks[i], groups[i]), None, None
                    draws = _generator(seed, level, *key)
                if ps[i] in (0.0, 1.0):
                    continue
                if held is not None:
                    old, ps[i] = pair(held[1], held[2], sizes[i], ps[i], draws.random())
                    held = (held[0], held[1], old)
                    if old in (0.0, 1.0):
                        yield close(held)
                        held, here = None, (i if ps[i] not in (0.0, 1.0) else None)
                elif here is not None:
                    ps[here], ps[i] = pair(sizes[here], ps[here], sizes[i], ps[i], draws.random())
                    if ps[here] in (0.0, 1.0):
                        here = i if ps[i] not in (0.0, 1.0) else None
                else:
                    here = i
            done = emit(batch, ps)
            if here is not None:
                held = (done.slice(here, 1), sizes[here], ps[here])
                if here:
                    yield done.slice(0, here)
                done = done.slice(here + 1)
            if done.num_rows:
                yield done
        if held is not None:
            yield close(held)

    return run


def _rounded(df: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """One level of the tree; larger documents first, so that small ones settle the rest."""
    dealt = df.repartition("rank", "grp").sortWithinPartitions("rank", "grp", F.desc("size"), "tie")
    return dealt.mapInArrow(_round_runs(seed, level, last), dealt.schema)


def _items(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows with rank, bucket, certain copies and the fractional rest of the copies."""
    found = rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    whole = F.floor("ratio").cast("double")
    bucket = F.pmod(F.xxhash64(F.lit(seed), "tie", "size"), F.col("buckets"))
    rest = F.when(F.col("size") == 0, 0.0).otherwise(F.col("ratio") - whole)
    rest = F.when(rest < EPSILON, 0.0).when(rest > 1 - EPSILON, 1.0).otherwise(rest)
    return found.select(ROW, "size", "source_size", "target", "rank", bucket.alias("grp"), whole.alias("whole"),
                        rest.alias("p"), F.xxhash64(F.lit(seed + 1), "tie").alias("tie"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 11, bucket_rows: int = 2048,
        fan_in: int = 256, sized: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` as column ``_row`` with size, source_size, target and copies.

    Null texts have size 0; a row of size 0 gets the certain copies only. Null sources are one source. Rows
    with equal ids, and equal rows, are rounded like any others. An empty table gives an empty result. The
    same rows and seed give the same copies: order and draws depend on values only (rows that agree in id and
    size may trade places). ``sized`` may hold (id, size, source) of the rows, to spare a pass over the texts.
    """
    narrow = sized if sized is not None else stored(
        docs.select(F.col(id_col).alias("tie"), text_size(F.col(text_col)).alias("size"), F.col(source_col).alias("source")), "sizes")
    targets = stored(source_targets(narrow, weights, share, cap, bucket_rows), "targets")
    marks = narrow.select(F.lit(None).cast("int").alias(ROW), "tie", "size", "source")
    top = targets.agg(F.max("buckets")).first()[0] or 1
    left = _rounded(_items(marks, targets, seed), seed, 0, top == 1).filter("p > 0 AND p < 1")
    left = stored(left.select("rank", "grp", "size", "p", F.col("grp").alias("bucket")), "residuals-0")
    settled, level = left.limit(0), 0
    while top > 1:
        top, level = -(-top // fan_in), level + 1
        again = left.select("rank", F.floor(F.col("grp") / fan_in).alias("grp"), "size", "p", "bucket", F.col("bucket").alias("tie"))
        done = stored(_rounded(again, seed, level, top == 1).drop("tie"), f"residuals-{level}")
        settled = settled.unionByName(done.filter("p = 0 OR p = 1"))
        left = done.filter("p > 0 AND p < 1")
    settled = settled.select(F.col("rank").alias("_rank"), F.col("bucket").alias("_bucket"), F.col("p").alias("_p"))
    if sized is not None:
        rows = sized.select(F.struct(F.col("tie").alias(id_col)).alias(ROW), "tie", "size", "source")
    else:
        packed = row_struct(docs)
        rows = packed.select(ROW, F.col(ROW)[id_col].alias("tie"), text_size(F.col(ROW)[text_col]).alias("size"), F.col(ROW)[source_col].alias("source"))
    rounded = _rounded(_items(rows, targets, seed), seed, 0, level == 0)
    open_row = (F.col("p") > 0) & (F.col("p") < 1)
    joined = rounded.withColumn("_open", F.when(open_row, F.col("grp"))).join(
        settled, (F.col("_open") == F.col("_bucket")) & (F.col("rank") == F.col("_rank")), "left")
    copies = (F.col("whole") + F.coalesce(F.col("_p"), F.col("p"))).cast("bigint")
    return joined.select(ROW, "size", "source_size", "target", copies.alias("copies"))


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(tie, size, source) of all rows, written once; what ``mix`` needs when no other column is wanted."""
    return stored(docs.select(F.col(id_col).alias("tie"), text_size(F.col(text_col)).alias("size"), F.col(source_col).alias("source")), "sizes")


def copies_of(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mix as they are taken: none, once or several times."""
    taken = mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(ROW)[c].alias(c) for c in columns])
