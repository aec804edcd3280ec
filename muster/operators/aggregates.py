"""Grouped reports. Every aggregate here combines on the map side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from muster import fixed_values as fv
from muster.functions.common import as_col, join_on
from muster.operators.ordered import first_rows, range_of, running_total


def any_pattern(patterns=fv.READY_PATTERNS) -> str:
    return "|".join(patterns)


def log_ready(lines: DataFrame, keys: list[str], line: str = "line", patterns=fv.READY_PATTERNS) -> DataFrame:
    """Whether any line of a job matches any of the patterns."""
    hit = F.coalesce(F.col(line).rlike(any_pattern(patterns)), F.lit(False))
    return lines.groupBy(*keys).agg(F.bool_or(hit).alias("ready"))


def phase_durations(edges: DataFrame, keys: list[str], edge: str = "edge", ts: str = "ts") -> DataFrame:
    """Start, stop and seconds of every phase; a phase that was never stopped has no duration."""
    spans = edges.groupBy(*keys).agg(
        F.min(F.when(F.col(edge) == "start", F.col(ts))).alias("started"),
        F.max(F.when(F.col(edge) == "stop", F.col(ts))).alias("stopped"),
    )
    return with_seconds(spans)


def with_seconds(spans: DataFrame) -> DataFrame:
    micros = F.unix_micros(F.col("stopped").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return spans.withColumn("seconds", F.when(micros >= 0, micros / F.lit(1_000_000.0)))


def phase_report(durations: DataFrame, phase: str = "phase", accuracy: int = 10_000) -> DataFrame:
    """Benchmark table: runs, runs left open, and times per phase.

    Times are summed as whole microseconds, so the mean does not depend on the order of rows.
    Percentiles come from mergeable sketches: exact up to ``accuracy`` runs of a phase, and off by
    at most one rank in ``accuracy`` beyond that.
    """
    micros = F.round(F.col("seconds") * 1_000_000).cast("bigint")
    return durations.groupBy(phase).agg(
        F.count("seconds").alias("closed"),
        F.count_if(F.col("seconds").isNull()).alias("open"),
        F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"),
        (F.sum(micros) / F.lit(1_000_000.0) / F.nullif(F.count("seconds"), F.lit(0))).alias("avg_seconds"),
        *[(F.percentile_approx(micros, p / 100, accuracy) / F.lit(1_000_000.0)).alias(f"p{p}_seconds") for p in (50, 95)],
    )


def match_counts(matched: DataFrame, keys: list[str], is_match: Column) -> DataFrame:
    """How many rows were listed and how many were matched."""
    return matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("listed"), F.count_if(is_match).alias("matched"))


def concat_names(groups: DataFrame, names: DataFrame, keys: list[str], name: str, names_per_part: int = 100_000) -> DataFrame:
    """Sorted names of every group as text, ``None`` for an empty group.

    ``part`` 0, 1, ... hold the first, second, ... ``names_per_part`` sorted names of a group, so
    the parts in order, joined by commas, are its whole list and no task ever builds an unbounded one.
    """
    listed = names.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_count"))
    placed = running_total(listed, keys, range_of(listed, [*keys, name]), [name], F.col("_count"), "_before")
    # An equal name is one row with a count, and is told once to every part it reaches into.
    part_at = lambda place: F.floor(place / names_per_part).cast("int")
    last = F.col("_before") + F.col("_count") - 1
    parts = placed.withColumn("part", F.explode(F.sequence(part_at(F.col("_before")), part_at(last))))
    begin = F.col("part").cast("bigint") * names_per_part
    held = F.least(last + 1, begin + names_per_part) - F.greatest("_before", begin)
    pieces = F.sort_array(F.collect_list(F.struct(F.col(name).alias("name"), held.cast("int").alias("times"))))
    spelled = F.flatten(F.transform(pieces, lambda p: F.array_repeat(p["name"], p["times"])))
    texts = parts.groupBy(*keys, "part").agg(F.array_join(spelled, ", ").alias("names"))
    out = join_on(groups.select(*keys).distinct(), texts, keys, "left")
    return out.select(
        *keys,
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("names", F.lit(fv.NONE_LISTED)).alias("names"),
    )


def check_summary(checks: DataFrame, keys: list[str], check: str, result: str, order: list[str], names=("health", "models", "query")) -> DataFrame:
    """One row per server with the last result of every check."""
    def last_result(n):
        at = F.when(F.col(check) == n, F.struct(*order))
        return F.coalesce(F.max_by(F.col(result), at), F.lit(fv.NOT_TESTED)).alias(n)

    return checks.groupBy(*keys).agg(*[last_result(n) for n in names])


def is_ready(port_open="port_open", health="health", log_hit="log_hit") -> Column:
    """A poll counts as ready with an open port and either a healthy answer or the log line."""
    return as_col(port_open) & (as_col(health) | as_col(log_hit))


def _outcome_of_polls(polls, keys, order, hit, payload, limit, good, bad):
    first = first_rows(polls.withColumn("_hit", hit).withColumn("_payload", payload), keys, order, limit, "_n")
    got = F.when(F.col("_hit"), F.col("_n"))
    at = [F.min_by(F.col(c), got).alias(c) for c in order]
    seen = first.groupBy(*keys).agg(
        F.min(got).alias("poll"),
        F.max("_n").alias("polls"),
        F.min_by("_payload", got).alias("payload"),
        *at,
    )
    status = (
        F.when(F.col("poll").isNotNull(), F.lit(good))
        .when(F.col("polls") >= limit, F.lit(bad))
        .otherwise(F.lit("pending"))
    )
    return seen.withColumn("status", status)


def time_to_ready(polls: DataFrame, keys: list[str], order: list[str], ready: Column, limit: int = fv.POLL_LIMIT) -> DataFrame:
    """First ready poll of every server within the first ``limit`` polls."""
    seen = _outcome_of_polls(polls, keys, order, ready, F.lit(None).cast("string"), limit, "ready", "failed")
    return seen.drop("payload", "polls")


def time_to_allocation(polls: DataFrame, keys: list[str], order: list[str], node: Column, limit: int = fv.POLL_LIMIT) -> DataFrame:
    """First usable node of every job within the first ``limit`` polls."""
    seen = _outcome_of_polls(polls, keys, order, node.isNotNull(), node, limit, "allocated", "timeout")
    return seen.withColumnRenamed("payload", "node").drop("polls")
