"""Joins of jobs, services, clients and keyed state.

All lookups are equi-joins against a side that is reduced to one row per key first, so a
row never multiplies. Spark chooses the join: a side is broadcast only when its measured
size allows it, and a hot key on the other side is split by AQE's skew join (see ``lookup_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from muster import fixed_values as fv
from muster.functions.common import first_set, lookup_join, set_or_null


def _one_per_key(registry: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """First registry entry for every value of ``key``."""
    best = F.min_by(F.struct("ord", *fields), F.col("ord")).alias("_e")
    return registry.filter(set_or_null(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_key")).agg(best)


def match_jobs(jobs: DataFrame, registry: DataFrame) -> DataFrame:
    """Give every job the first registry entry that has its id or its name.

    ``jobs`` needs ``job_id, name``; ``registry`` needs ``ord, server, job_id, job_name,
    remote_port``. The condition is an OR; instead of one join on it there are two lookups
    with equal keys, and the entry that comes first in the registry wins.
    """
    fields = ["server", "remote_port"]
    by_id = _one_per_key(registry, "job_id", fields).select(F.col("_key").alias("_id"), F.col("_e").alias("_by_id"))
    by_name = _one_per_key(registry, "job_name", fields).select(F.col("_key").alias("name"), F.col("_e").alias("_by_name"))
    # least() over structs compares ord first; ord is unique, so the rest never decides.
    best = F.least("_by_id", "_by_name")
    port = F.coalesce(best["remote_port"].cast("string"), F.lit(str(fv.DEFAULT_PORT)))
    found = lookup_join(jobs.withColumn("_id", F.col("job_id").cast("string")), by_id, ["_id"])
    return lookup_join(found, by_name, ["name"]).select(
        *jobs.columns,
        F.coalesce(best["server"], F.lit(fv.UNKNOWN)).alias("server"),
        F.when(best.isNull(), F.lit(fv.UNKNOWN)).otherwise(port).alias("port"),
    )


def _pieces(text: Column, n: Column) -> Column:
    """Distinct pieces of ``n`` characters, none of a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, n)))).otherwise(F.array().cast("array<string>"))


def contains_pairs(names: DataFrame, needles: DataFrame) -> DataFrame:
    """All ``(name, needle)`` with the needle somewhere in the name, without a nested loop.

    Both inputs are single columns of distinct non-empty texts. Names are cut into pieces of
    exactly the lengths that needles have, so a piece that equals a needle is a hit and
    nothing has to be checked afterwards. The work grows with the names, times the number of lengths.
    """
    # One number per length, at most as many as the longest needle has characters.
    lengths = needles.agg(F.sort_array(F.collect_set(F.length("needle")))).scalar()
    pieces = names.select("name", F.explode(lengths).alias("_n")).select("name", F.explode(_pieces(F.col("name"), F.col("_n"))).alias("needle"))
    return lookup_join(pieces, needles.select("needle").distinct(), ["needle"], "left_semi").select("name", "needle")


def match_jobs_by_pattern(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs that each request is about: ``req_id, job_id, name, rule``.

    ``requests`` needs ``req_id, pattern, job_name, stored_job_id``. A pattern is searched in
    the job name; jobs it does not hit are searched by the request's own job name. A request
    without a pattern whose stored job is listed is about that job alone.
    """
    jobs = jobs.select(F.col("job_id").cast("string").alias("job_id"), "name")
    asked = requests.select(
        "req_id",
        set_or_null("pattern").alias("pattern"),
        set_or_null("job_name").alias("job_name"),
        set_or_null("stored_job_id").alias("stored"),
    )
    # A job id may be listed more than once; every row of it is an answer.
    by_id = asked.filter(F.col("pattern").isNull() & F.col("stored").isNotNull())
    stored = by_id.join(jobs, by_id["stored"] == jobs["job_id"]).select(
        "req_id", "job_id", "name", F.lit("stored").alias("rule")
    )
    open_asked = asked.join(stored.select("req_id").distinct(), "req_id", "left_anti")
    searched = open_asked.select(
        "req_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("o"), F.lit("pattern").alias("rule"), F.col("pattern").alias("needle")),
                F.struct(F.lit(1).alias("o"), F.lit("name").alias("rule"), F.col("job_name").alias("needle")),
            )
        ).alias("s"),
    ).select("req_id", "s.*").filter(F.col("needle").isNotNull())
    names = jobs.filter(F.col("name") != "").select("name").distinct()
    pairs = contains_pairs(names, searched.select("needle").distinct())
    rules = (
        searched.join(pairs, "needle")
        .groupBy("req_id", "name")
        .agg(F.min_by("rule", "o").alias("rule"))
    )
    found = rules.join(jobs, "name").select("req_id", "job_id", "name", "rule")
    return stored.unionByName(found)


def keep_live(state: DataFrame, live: DataFrame, col: str = "pid") -> DataFrame:
    """State entries whose process still runs."""
    running = live.select(col).filter(F.col(col).isNotNull()).distinct()
    return lookup_join(state, running, [col], "left_semi")


def delete_keys(state: DataFrame, keys: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """State without the keys, and per asked key what was removed or that nothing was there."""
    asked = keys.select(key).distinct()
    rest = state.join(asked, key, "left_anti").select(*state.columns)
    had = state.select(key, F.col("pid").cast("string").alias("_pid"), F.lit(True).alias("_had"))
    outcome = asked.join(had, key, "left").select(
        key,
        F.coalesce("_had", F.lit(False)).alias("removed"),
        F.when(F.col("_had"), F.col("_pid")).otherwise(F.lit(fv.NO_ENTRY)).alias("detail"),
    )
    return rest, outcome


def insert_absent(existing: DataFrame, new: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Both tables together; a key in both keeps the existing row unless ``overwrite``."""
    base, extra = (new, existing) if overwrite else (existing, new)
    added = extra.join(base.select(key).distinct(), key, "left_anti").select(*extra.columns)
    return base.unionByName(added)


def resolve_backend(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """Port for every client.

    ``clients`` has ``override_port, default_server``; ``servers`` has ``ord, server,
    local_port, job_id``. Override first, then the default server's port (8000 if that
    server has no entry or no port), then the first server with a job, then 8000.
    """
    base = F.lit(fv.DEFAULT_PORT)
    ports = servers.filter(F.col("server").isNotNull()).groupBy("server").agg(F.min_by("local_port", "ord").alias("_port"))
    with_job = F.when(first_set("job_id").isNotNull(), F.col("ord"))
    running = servers.agg(F.min_by(F.coalesce("local_port", base), with_job).alias("port")).scalar()
    named = set_or_null("default_server")
    return (
        lookup_join(clients.withColumn("server", named), ports, ["server"])
        .withColumn(
            "port",
            F.coalesce(
                F.nullif(F.col("override_port"), F.lit(0)),
                F.when(named.isNotNull(), F.coalesce("_port", base)),
                running,
                base,
            ),
        )
        .select(*clients.columns, "port")
    )


def first_by_source(candidates: DataFrame, keys: list[str], value: str = "value", rank: str = "rank") -> DataFrame:
    """Value of the best-ranked source that has one; keys without any stay with null."""
    held = F.when(set_or_null(value).isNotNull(), F.col(rank))
    return candidates.groupBy(*keys).agg(F.min_by(value, held).alias(value))


def default_host(servers: DataFrame, keys: list[str]) -> DataFrame:
    """Host of every group's default server, or of its first server when no default is set.

    ``servers`` has ``ord, server, host, default_server``; a default that is not among the
    group's servers has no host.
    """
    named = F.when(F.col("server") == set_or_null("default_server"), F.col("ord"))
    return (
        servers.groupBy(*keys)
        .agg(
            F.min_by("host", "ord").alias("_first"),
            F.min_by("host", named).alias("_default"),
            F.max(set_or_null("default_server")).alias("_name"),
        )
        .select(*keys, F.when(F.col("_name").isNull(), F.col("_first")).otherwise(F.col("_default")).alias("host"))
    )
