"""Rendering of one service record: maps, flags, scripts, batch headers and commands."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from muster import fixed_values as fv
from muster.functions.common import ColumnOrName, as_col, first_set, set_or_null
from muster.functions.text import container_name, strip


def overlay(base: ColumnOrName, override: ColumnOrName) -> Column:
    """Both maps as one; the right one wins. Needs no map-key policy setting."""
    base, override = as_col(base), as_col(override)
    empty = F.create_map().cast("map<string,string>")
    override = F.coalesce(override, empty)
    kept = F.map_filter(F.coalesce(base, empty), lambda k, v: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def get_any_case(m: ColumnOrName, key: str) -> Column:
    """Value under the upper-case name, or else under the lower-case name."""
    m = as_col(m)
    return F.coalesce(set_or_null(m[key.upper()]), m[key.lower()])


def render_kv(m: ColumnOrName) -> Column:
    """``KEY=value`` lines."""
    lines = F.transform(
        F.map_entries(as_col(m)),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))),
    )
    return F.array_join(lines, "\n")


def serialise(*cols: ColumnOrName) -> Column:
    """Named columns as one JSON text, missing fields left out."""
    return F.to_json(F.struct(*[as_col(c) for c in cols]))


def extra_lines(s: ColumnOrName) -> Column:
    """Lines of a multi-line value, trimmed, blank ones dropped."""
    parts = F.transform(F.split(as_col(s), fv.LINE_END), lambda x: strip(x))
    return F.filter(parts, lambda x: x != "")


def _flags(record: Column, platform: str) -> Column:
    none = F.array().cast("array<string>")
    parts = []
    for flag, field, default in fv.START_FLAGS[platform]:
        value = record[field]
        if field == "extra_args":
            parts.append(F.coalesce(extra_lines(value), none))
        elif flag in fv.SWITCH_FLAGS:
            off = F.lower(F.coalesce(value, F.lit(default))).isin("", "0", "false")
            parts.append(F.when(off, none).otherwise(F.array(F.lit(flag))))
        elif default is None:
            dropped = set_or_null(value).isNull() | (value == "0")
            parts.append(F.when(dropped, none).otherwise(F.array(F.concat(F.lit(flag + " "), value))))
        else:
            parts.append(F.array(F.concat(F.lit(flag + " "), F.coalesce(value, F.lit(default)))))
    return F.concat(*parts)


def _by_platform(platform: Column, build) -> Column:
    return (
        F.when(platform == "uva", build("uva"))
        .when(platform == "dgx", build("dgx"))
        .otherwise(build("default"))
    )


def start_flags(record: ColumnOrName, platform: ColumnOrName) -> Column:
    """Ordered flags of the start command as an array."""
    record = as_col(record)
    return _by_platform(as_col(platform), lambda p: _flags(record, p))


def start_script(record: ColumnOrName, platform: ColumnOrName, background: bool = False) -> Column:
    """Whole start script of one record."""
    record = as_col(record)
    name = record["name"]

    def command_field(field):
        if field == "container":
            return container_name(name)
        return F.coalesce(record[field], F.lit(fv.START_COMMAND_DEFAULTS[field]))

    def build(p):
        outer, inner = fv.START_INDENT[p]
        command = F.concat(*[
            F.lit(part) if i % 2 == 0 else command_field(part)
            for i, part in enumerate(re.split(r"(?<!\$)\{(\w+)\}", fv.START_COMMAND[p]))
        ])
        flags = F.transform(_flags(record, p), lambda f: F.concat(F.lit(" " * inner), f, F.lit(" \\")))
        return F.concat(
            F.lit(f"#!/bin/bash\n{' ' * outer}mkdir -p {fv.START_LOG_DIR}\n{' ' * outer}"),
            F.lit("nohup " if background else ""),
            command,
            F.array_join(flags, "\n"),
            F.lit(f" > {fv.START_LOG_DIR}/"),
            name,
            F.lit(".log 2>&1" + (" &" if background else "")),
        )

    return _by_platform(as_col(platform), build)


def batch_header(record: ColumnOrName, folder: ColumnOrName, script: ColumnOrName) -> Column:
    """Batch file: directives, optional partition and reservation, then the script to run."""
    record, folder = as_col(record), as_col(folder)
    name = record["name"]

    def directive(key, *value):
        return F.concat(F.lit(f"#SBATCH --{key}="), *value)

    def default(field):
        return F.coalesce(record[field], F.lit(fv.BATCH_DEFAULTS[field]))

    def optional(field):
        return F.when(first_set(record[field]).isNotNull(), directive(field, record[field]))

    lines = F.concat_ws(
        "\n",
        F.lit("#!/bin/bash"),
        directive("job-name", F.lit(fv.BATCH_JOB_PREFIX), name),
        directive("output", folder, F.lit("/"), name, F.lit("_%j.out")),
        directive("error", folder, F.lit("/"), name, F.lit("_%j.err")),
        optional("partition"),
        optional("reservation"),
        directive("gres", F.lit("gpu:"), default("gres")),
        directive("cpus-per-task", default("cpus")),
        directive("mem", default("mem")),
        directive("time", default("time")),
    )
    return F.concat(lines, F.lit("\n\n"), as_col(script), F.lit("\n"))


def submit_command(record: ColumnOrName, mode: ColumnOrName, script: ColumnOrName, batch_file: ColumnOrName) -> Column:
    """Struct of ``command`` and ``error``; one of them is null. A bad record is a row, not a failure."""
    record, mode, script = as_col(record), as_col(mode), as_col(script)
    batch_file = set_or_null(batch_file)
    partition, reservation = set_or_null(record["partition"]), set_or_null(record["reservation"])
    interactive = F.concat_ws(
        " ",
        F.lit("ijob -p"),
        partition,
        F.when(reservation.isNotNull(), F.concat(F.lit("--reservation="), reservation)),
        script,
    )
    error = (
        F.when((mode == "sbatch") & batch_file.isNull(), F.lit("batch file is required for sbatch mode"))
        .when(
            (mode == "ijob") & partition.isNull(),
            F.concat(F.lit("partition is required for interactive startup of "), record["name"]),
        )
        .when(~mode.isin("sbatch", "ijob") | mode.isNull(), F.concat(F.lit("unsupported execution mode: "), F.coalesce(mode, F.lit(""))))
    )
    command = F.when(mode == "sbatch", F.concat(F.lit("sbatch "), batch_file)).otherwise(interactive)
    return F.struct(F.when(error.isNull(), command).alias("command"), error.alias("error"))


def interactive_command(record: ColumnOrName) -> Column:
    """Interactive allocation command; null when a required field is not set."""
    record = as_col(record)
    fields = {f: set_or_null(record[f]) for f in (*fv.REQUIRED_INTERACTIVE, "reservation")}
    ready = reduce(lambda a, f: a & fields[f].isNotNull(), fv.REQUIRED_INTERACTIVE, F.lit(True))
    text = F.concat_ws(
        " ",
        F.lit("ijob -c 1 -A"),
        fields["allocation"],
        F.lit("-p"),
        fields["partition"],
        F.concat(F.lit("--time="), fields["time"]),
        F.concat(F.lit("--gres="), fields["gres"]),
        F.concat(F.lit("--reservation="), fields["reservation"]),
    )
    return F.when(ready, text)
