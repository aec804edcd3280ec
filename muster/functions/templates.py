"""Template rendering over map columns, inside the row and inside the JVM.

A binding map holds the values for ``{key}``. ``${key}`` belongs to the shell and
is never touched by the guarded forms.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from muster import fixed_values as fv
from muster.functions.common import ColumnOrName, as_col, first_set

# Stands for "${" while placeholders are replaced.
_HIDDEN = "\u0001"


def _slot(key: Column) -> Column:
    return F.concat(F.lit("{"), key, F.lit("}"))


def _hide(s: Column) -> Column:
    return F.replace(s, F.lit("${"), F.lit(_HIDDEN))


def _show(s: Column) -> Column:
    return F.replace(s, F.lit(_HIDDEN), F.lit("${"))


def _fill(text: Column, bindings: Column) -> Column:
    return F.reduce(
        F.map_entries(bindings),
        text,
        lambda acc, e: F.when(e["value"].isNull(), acc).otherwise(F.replace(acc, _slot(e["key"]), e["value"])),
    )


def render_once(template: ColumnOrName, bindings: ColumnOrName) -> Column:
    """Replace each ``{key}`` once, in map order, with no guard for ``${``; a null value is written ``None``."""
    written = F.transform_values(as_col(bindings), lambda k, v: F.coalesce(v, F.lit(fv.NULL_TEXT)))
    return _fill(as_col(template), written)


def fill_path(pattern: ColumnOrName, default: ColumnOrName, user: ColumnOrName, port: ColumnOrName) -> Column:
    """Path pattern, or its default, with ``{user}`` and ``{port}`` filled."""
    port = F.coalesce(as_col(port).cast("string"), F.lit(str(fv.DEFAULT_PORT)))
    path = F.coalesce(first_set(pattern, default), F.lit(""))
    path = F.replace(path, F.lit("{user}"), F.coalesce(as_col(user), F.lit("")))
    return F.replace(path, F.lit("{port}"), port)


def launch_error(record: ColumnOrName, path: ColumnOrName) -> Column:
    """Why a record has no launch script, null where it has one."""
    reason = F.concat(F.lit("Configuration at '"), as_col(path), F.lit("' " + fv.NO_SCRIPT))
    return F.when(first_set(as_col(record)["script"]).isNull(), reason)


def launch_script(record: ColumnOrName, title: ColumnOrName) -> Column:
    """Shell script of one record: preamble, then its ``script`` field rendered once.

    Null when the record has no script; ``launch_error`` then says so.
    """
    record = as_col(record)
    others = F.map_filter(record, lambda k, v: k != "script")
    body = render_once(record["script"], others)
    gpu = F.coalesce(first_set(record["tensor_parallel_size"]), record["gpus"], F.lit("1"))
    body = F.replace(body, F.lit("{gpu}"), gpu)
    return F.when(
        first_set(record["script"]).isNotNull(),
        F.concat(
            F.lit("#!"),
            F.coalesce(record["shell"], F.lit(fv.DEFAULT_SHELL)),
            F.lit("\n" + fv.LAUNCH_TITLE),
            as_col(title),
            F.lit("\n\nexport PORT="),
            F.coalesce(record["remote_port"], F.lit(str(fv.DEFAULT_PORT))),
            F.lit(f'\nexport {fv.LAUNCH_IMAGE_VAR}="'),
            F.coalesce(record["image"], F.lit(fv.DEFAULT_IMAGE)),
            F.lit('"\n\n'),
            body,
        ),
    )


def resolve_bindings(bindings: ColumnOrName) -> Column:
    """Bindings whose values refer to each other, expanded until nothing is left to expand.

    Every pass puts the current values of all bindings into all values, so the depth
    that is resolved doubles with each pass and log2(number of keys) passes are enough.
    A binding that has come to contain itself is part of a cycle; it is left alone from
    then on, so its placeholder stays visible.
    """
    hidden = F.transform_values(as_col(bindings), lambda k, v: _hide(v))

    def one_pass(m):
        usable = F.map_filter(m, lambda k, v: ~F.contains(v, _slot(k)))
        return F.transform_values(m, lambda k, v: F.when(F.contains(v, F.lit("{")), _fill(v, usable)).otherwise(v))

    passes = F.ceil(F.log2(F.size(hidden) + F.lit(1))).cast("int") + F.lit(1)
    return F.transform_values(
        F.reduce(F.sequence(F.lit(1), passes), hidden, lambda m, i: one_pass(m)),
        lambda k, v: _show(v),
    )


def render_resolved(template: ColumnOrName, resolved: ColumnOrName) -> Column:
    """One guarded pass with bindings that ``resolve_bindings`` has closed."""
    hidden = F.transform_values(as_col(resolved), lambda k, v: _hide(v))
    return _show(_fill(_hide(as_col(template)), hidden))


def render_fixpoint(template: ColumnOrName, bindings: ColumnOrName) -> Column:
    return render_resolved(template, resolve_bindings(bindings))


def is_converged(text: ColumnOrName, bindings: ColumnOrName) -> Column:
    """False if a placeholder for a known key is left, which only a cycle can cause."""
    shown = _hide(as_col(text))
    known = F.map_keys(F.map_filter(as_col(bindings), lambda k, v: v.isNotNull()))
    return ~F.exists(known, lambda k: F.contains(shown, _slot(k)))
