"""Projections, filters and status rules over single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from muster import fixed_values as fv
from muster.functions.common import ColumnOrName, as_col, lookup_join


def project_with_defaults(df: DataFrame, defaults: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """Fields as text, each with the text to show when it is missing."""
    return df.select(*keep, *[F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c) for c, d in defaults.items()])


def service_table(df: DataFrame, name: str = "name") -> DataFrame:
    return project_with_defaults(df, fv.SERVICE_FIELDS, [name])


def filter_name_contains(df: DataFrame, col: ColumnOrName, token: str = fv.JOB_TOKEN) -> DataFrame:
    return df.filter(F.contains(as_col(col), F.lit(token)))


def filter_members(df: DataFrame, col: str, registry: DataFrame, registry_col: str, builtin=fv.BUILTIN_CLIENTS) -> DataFrame:
    """Rows whose name is in the registry or in the fixed list."""
    known = registry.select(F.col(registry_col).alias(col)).filter(F.col(col).isNotNull()).distinct()
    is_member = F.coalesce("_known", F.col(col).isin(*builtin))
    return lookup_join(df, known.withColumn("_known", F.lit(True)), [col]).filter(is_member).select(*df.columns)


def absent_fields(record: ColumnOrName, required) -> Column:
    """Required keys the record does not have at all."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(as_col(record)))


def unset_fields(record: ColumnOrName, required) -> Column:
    """Required keys that are absent, null or empty."""
    filled = F.map_filter(as_col(record), lambda k, v: v.isNotNull() & (v != ""))
    return absent_fields(filled, required)


def split_range(df: DataFrame, col: str, low: int = fv.PORT_MIN, high: int = fv.PORT_MAX) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that are rejected; null and 0 mean no override and pass."""
    ok = in_range(col, low, high)
    return df.filter(ok), df.filter(~ok)


def in_range(col: ColumnOrName, low: int = fv.PORT_MIN, high: int = fv.PORT_MAX) -> Column:
    c = as_col(col)
    return F.coalesce((c == 0) | c.between(low, high), F.lit(True))


def _first_contained(host: Column, rule, otherwise: str) -> Column:
    host = F.lower(host)
    out = F.lit(otherwise)
    for part, result in reversed(rule):
        out = F.when(F.contains(host, F.lit(part)), F.lit(result)).otherwise(out)
    return out


def route(host: ColumnOrName) -> Column:
    """Which kind of service a host runs."""
    return _first_contained(as_col(host), fv.ROUTE_RULE, fv.ROUTE_ELSE)


def platform(host: ColumnOrName) -> Column:
    """Platform name of a host for a new record."""
    return _first_contained(as_col(host), fv.PLATFORM_RULE, fv.PLATFORM_ELSE)


def probe_status(health: ColumnOrName, models: ColumnOrName) -> Column:
    """Three-way state of a probe. A null status is a connection that failed.

    The second probe is only made after the first succeeded, so its failure also
    reads as a lost connection.
    """
    health, models = as_col(health), as_col(models)
    return (
        F.when(health.isNull(), F.lit("OFFLINE"))
        .when(health != 200, F.lit("STARTING"))
        .when(models.isNull(), F.lit("OFFLINE"))
        .when(models != 200, F.lit("STARTING"))
        .otherwise(F.lit("READY"))
    )


def server_status(running: ColumnOrName, health: ColumnOrName) -> Column:
    running, health = as_col(running), as_col(health)
    return (
        F.when(~F.coalesce(running, F.lit(False)), F.lit("Stopped"))
        .when(health == 200, F.lit("Running"))
        .otherwise(F.lit("Starting/Unhealthy"))
    )


def default_record(host: ColumnOrName, label: str, folder: str, model: str = fv.DEFAULT_MODEL) -> Column:
    """Complete record for a new host. ``label`` starts its name, ``folder`` is part of its path."""
    host = as_col(host)
    kind = platform(host)

    def by_kind(values):
        last = F.lit(values[fv.PLATFORM_ELSE])
        return F.when(kind == "uva", F.lit(values["uva"])).when(kind == "dgx", F.lit(values["dgx"])).otherwise(last)

    port = by_kind(fv.PLATFORM_PORT)
    return F.struct(
        F.concat(F.lit(f"{label}-"), host).alias("name"),
        kind.alias("platform"),
        host.alias("host"),
        F.concat(F.lit("{~/.ssh/config:"), host, F.lit(".user}")).alias("user"),
        F.concat(by_kind(fv.PLATFORM_ROOT), F.lit("/{user}/%s/{port}" % folder)).alias("dir"),
        port.alias("local_port"),
        port.alias("remote_port"),
        F.lit(model).alias("model"),
    )


def describe_record(df: DataFrame, keys: list[str], record: ColumnOrName) -> DataFrame:
    """One ``key: value`` line per field."""
    exploded = df.select(*keys, F.posexplode(F.map_entries(as_col(record))).alias("pos", "_e"))
    shown = F.coalesce(F.col("_e.value"), F.lit("None"))
    return exploded.select(*keys, "pos", F.concat(F.col("_e.key"), F.lit(": "), shown).alias("line"))
