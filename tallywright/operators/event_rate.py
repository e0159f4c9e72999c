"""Events over a sliding limit per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

SLICES = 64
#: Windows in a run of slices that one task orders; each run also sees the run before it.
SLICE_BLOCKS = 64


def over_limit_events(
    events: DataFrame, max_events: int, window_seconds: int = 60, slices: int = SLICES
) -> DataFrame:
    """Count earlier events of the same key in (t - window, t), over-limit flag and what remains.

    ``events`` has ``key`` and ``ts``. Events of one key at one instant collapse; refused events
    still count. The window is cut into equal slices: an event counts the earlier events of its own
    slice, the whole slices in between, and the part of the oldest slice that is still inside. A busy
    key is therefore spread over its slices and never ordered in one task.
    """
    width = window_seconds * 1_000_000
    slices = max(n for n in range(1, slices + 1) if width % n == 0)
    step = width // slices
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = events.select("key", "ts").distinct().select("key", "ts", micros.alias("at"))
    own = own.withColumn("slice", ((F.col("at") - F.pmod("at", F.lit(step))) / step).cast("bigint"))
    arrived = own.select("key", "ts", "at", "slice", F.lit(1).alias("is_event"))
    leaving = own.select(
        "key", F.lit(None).cast(own.schema["ts"].dataType).alias("ts"), (F.col("at") + width).alias("at"),
        (F.col("slice") + slices).alias("slice"), F.lit(0).alias("is_event"),
    )
    in_slice = W.partitionBy("key", "slice").orderBy("at")
    earlier_here = F.sum("is_event").over(in_slice.rangeBetween(W.unboundedPreceding, -1))
    still_inside = F.sum(1 - F.col("is_event")).over(in_slice.rangeBetween(1, W.unboundedFollowing))
    local = arrived.unionByName(leaving).select(
        "key", "ts", "slice", "is_event",
        (F.coalesce(earlier_here, F.lit(0)) + F.coalesce(still_inside, F.lit(0))).alias("partial"),
    ).filter("is_event = 1")
    whole = own.groupBy("key", "slice").agg(F.count(F.lit(1)).alias("slice_events"))
    block = F.floor(F.col("slice") / (slices * SLICE_BLOCKS))
    spread = whole.withColumn("_home", block).withColumn("_block", F.explode(F.array(block, block + 1)))
    between = W.partitionBy("key", "_block").orderBy("slice").rangeBetween(-(slices - 1), -1)
    middle = spread.select(
        "key", "slice", "_home", "_block", F.coalesce(F.sum("slice_events").over(between), F.lit(0)).alias("middle")
    ).filter("_home = _block").select("key", "slice", "middle")
    earlier = F.col("partial") + F.col("middle")
    return local.join(middle, ["key", "slice"]).select(
        "key",
        "ts",
        earlier.alias("earlier"),
        (earlier >= max_events).alias("over_limit"),
        F.greatest(F.lit(0), max_events - earlier - 1).alias("remaining"),
    )
