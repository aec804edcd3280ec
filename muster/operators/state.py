"""Keyed state such as ``host:port -> pid``: folding a batch of start and stop changes into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from muster.functions.common import lookup_join
from muster.operators.ordered import range_of

START, STOP = "start", "stop"


def fold_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State after the changes, taken in the order of ``seq``.

    ``state`` is ``key, pid``; ``changes`` is ``key, op, pid, seq`` with a struct or number
    as ``seq``. A start of a key that is there is refused, so the first start behind the
    last stop holds, and without a stop the old entry holds. Nothing depends on how many
    changes a single key has: both steps combine before the shuffle.
    """
    stops = changes.groupBy("key").agg(F.max(F.when(F.col("op") == STOP, F.col("seq"))).alias("_stop"))
    starts = lookup_join(changes.filter(F.col("op") == START), stops, ["key"])
    valid = starts.filter(F.col("_stop").isNull() | (F.col("seq") > F.col("_stop")))
    started = valid.groupBy("key").agg(F.min_by("pid", "seq").alias("_new"))
    return (
        state.select("key", F.col("pid").alias("_old"), F.lit(True).alias("_had"))
        .join(stops.withColumn("_changed", F.lit(True)), "key", "full_outer")
        .join(started.withColumn("_started", F.lit(True)), "key", "left")
        .withColumn("_kept", F.col("_had") & F.col("_stop").isNull())
        .filter(F.coalesce("_kept", F.lit(False)) | F.coalesce("_started", F.lit(False)))
        .select("key", F.when(F.col("_kept"), F.col("_old")).otherwise(F.col("_new")).alias("pid"))
    )


def start_outcomes(state: DataFrame, changes: DataFrame, already: str) -> DataFrame:
    """``key, seq, started, detail`` of every start: the process it started, or that the key was active then.

    A key is active behind a start, whether that was accepted or refused, and not behind a stop;
    before its first change the state decides. Only the last change of each earlier range of
    (key, seq) is looked at across ranges, so a key with many changes is worked on by many tasks.
    """
    ranged = changes.select("key", "op", "pid", "seq", range_of(changes, ["key", "seq"]).alias("_range"))
    lasts = ranged.groupBy("key", "_range").agg(F.max_by("op", "seq").alias("_last"))
    earlier = lasts.withColumn("_last", F.lag("_last").over(W.partitionBy("key").orderBy("_range")))
    inside = F.lag("op").over(W.partitionBy("key", "_range").orderBy("seq"))
    before = lookup_join(ranged.withColumn("_inside", inside), earlier, ["key", "_range"]).filter(F.col("op") == START)
    had = state.select("key", F.lit(True).alias("_had")).distinct()
    known = lookup_join(before.withColumn("_before", F.coalesce("_inside", "_last")), had, ["key"])
    held = F.when(F.col("_before").isNull(), F.coalesce("_had", F.lit(False))).otherwise(F.col("_before") == START)
    return known.select("key", "seq", (~held).alias("started"), F.when(held, F.lit(already)).otherwise(F.col("pid").cast("string")).alias("detail"))
