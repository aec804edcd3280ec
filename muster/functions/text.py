"""Scalar text functions. Every one is a built-in column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from muster import fixed_values as fv
from muster.functions.common import ColumnOrName, as_col, set_or_null


def expand_user(s: ColumnOrName, user: ColumnOrName) -> Column:
    """Put the user in place of ``$USER``; without a user the text stays."""
    s, user = as_col(s), set_or_null(user)
    return F.when(user.isNull(), s).otherwise(F.replace(s, F.lit("$USER"), user))


def expand_home(path: ColumnOrName, home: ColumnOrName) -> Column:
    """Leading ``~`` and every ``$HOME`` become the home folder."""
    path, home = as_col(path), as_col(home)
    tilde = (path == "~") | path.startswith("~/")
    opened = F.when(tilde, F.concat(home, F.substr(path, F.lit(2)))).otherwise(path)
    return F.replace(opened, F.lit("$HOME"), home)


def override_port_flag(s: ColumnOrName, port: ColumnOrName) -> Column:
    """Rewrite every ``--port <digits>``; port null or 0 means no override."""
    s, port = as_col(s), as_col(port)
    new = F.regexp_replace(s, F.lit(r"--port\s+\d+"), F.concat(F.lit("--port "), port.cast("string")))
    return F.when(port.isNull() | (port == 0), s).otherwise(new)


def override_name_suffix(s: ColumnOrName, port: ColumnOrName) -> Column:
    """Replace the number behind the last underscore; port null or 0 means no override."""
    s, port = as_col(s), as_col(port)
    new = F.regexp_replace(s, F.lit(r"_\d+$"), F.concat(F.lit("_"), port.cast("string")))
    return F.when(port.isNull() | (port == 0), s).otherwise(new)


def normalise_shebang(s: ColumnOrName, shell: ColumnOrName | None = None) -> Column:
    """Make the first line name the given shell."""
    s, shell = as_col(s), F.lit(fv.DEFAULT_SHELL) if shell is None else as_col(shell)
    bang = F.concat(F.lit("#!"), shell)
    return (
        F.when(~s.startswith("#!"), F.concat(bang, F.lit("\n"), s))
        .when(F.startswith(s, bang), s)
        .otherwise(F.concat(bang, F.regexp_replace(s, r"^#![^\n]*", "")))
    )


def extract_job_id(s: ColumnOrName) -> Column:
    """Job number in the scheduler's answer, null if there is none."""
    return F.nullif(F.regexp_extract(as_col(s), fv.SUBMITTED, 1), F.lit(""))


def ensure_prefix(s: ColumnOrName, prefix: str = fv.MODEL_PREFIX) -> Column:
    s = as_col(s)
    return F.when(s.startswith(prefix), s).otherwise(F.concat(F.lit(prefix), s))


def mask(s: ColumnOrName) -> Column:
    """Show only the ends of a longer value."""
    s = as_col(s)
    ends = F.concat(F.left(s, F.lit(4)), F.lit("..."), F.right(s, F.lit(4)))
    return F.when(F.length(s) > 8, ends).otherwise(F.lit("****"))


def preview(s: ColumnOrName, n: int = fv.PREVIEW_CHARS) -> Column:
    """Trimmed text cut to its first ``n`` characters (a display column)."""
    return F.left(strip(s), F.lit(n))


def strip(s: ColumnOrName) -> Column:
    """Cut white space of every kind at both ends."""
    return F.btrim(as_col(s), F.lit(fv.SPACE_CHARS))


def is_placeholder(s: ColumnOrName) -> Column:
    """The whole value is one ``{...}``."""
    s = as_col(s)
    return s.startswith("{") & s.endswith("}") & (F.length(s) > 1)


def expand_var(s: ColumnOrName, value: ColumnOrName) -> Column:
    s = as_col(s)
    return F.when(is_placeholder(s), as_col(value).cast("string")).otherwise(s)


def placeholder_key(s: ColumnOrName) -> Column:
    """Name between the braces, null for a plain value."""
    s = as_col(s)
    return F.when(is_placeholder(s), F.substr(s, F.lit(2), F.length(s) - 2))


def container_name(name: ColumnOrName, prefix: str = fv.CONTAINER_PREFIX) -> Column:
    return F.concat(F.lit(prefix), as_col(name))


def first_node(nodes: ColumnOrName) -> Column:
    """First of a comma list; empty text and the scheduler's marker mean no node."""
    nodes = strip(nodes)
    usable = (nodes != "") & (nodes != fv.NO_NODE)
    return F.when(usable, F.split_part(nodes, F.lit(","), F.lit(1)))


def first_listed_node(nodes: ColumnOrName) -> Column:
    """Name of the first struct in a node array, or the word for an unknown node."""
    return F.coalesce(F.get(as_col(nodes), F.lit(0))["name"], F.lit(fv.UNKNOWN))
