"""Nested configuration documents as rows: one row per leaf.

A leaf is ``(keys..., path array<string>, value string)`` where ``value`` is JSON text.
Empty objects and arrays are leaves. ``null`` is a value of its own, not a missing one.
Paths are arrays because keys may contain dots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from muster.functions.common import ColumnOrName, as_col, lookup_join

EMPTY_OBJECT = "{}"


def parse_doc(text: ColumnOrName) -> Column:
    """JSON text as a variant; empty text is an empty document, broken text gives null."""
    text = F.trim(as_col(text))
    return F.try_parse_json(F.when(text == "", F.lit(EMPTY_OBJECT)).otherwise(text))


def variant_path(parts: Sequence[str] | str) -> str:
    """Variant path for key names; a plain string is split at its dots."""
    parts = parts.split(".") if isinstance(parts, str) else parts
    return "$" + "".join('["%s"]' % p if "'" in p else "['%s']" % p for p in parts)


def lookup_path(doc: ColumnOrName, parts: Sequence[str] | str, as_type: str = "string") -> Column:
    """Value at a path, null if any step is missing."""
    return F.try_variant_get(as_col(doc), variant_path(parts), as_type)


def _children(node: Column) -> Column:
    """Members of an object, null for anything else and for an empty object."""
    members = F.try_variant_get(node, "$", "map<string,variant>")
    return F.when(F.size(members) > 0, members)


def nesting_depth(doc: ColumnOrName) -> Column:
    """How many objects lie in one another at most, counted on the JSON text without its strings."""
    unescaped = F.regexp_replace(F.to_json(as_col(doc)), r"\\.", "")
    marks = F.regexp_replace(F.regexp_replace(unescaped, r'"[^"]*+"', ""), r"[^{}]", "")
    steps = F.transform(F.split(marks, ""), lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.reduce(
        steps,
        start,
        lambda at, step: F.struct((at["now"] + step).alias("now"), F.greatest(at["most"], at["now"] + step).alias("most")),
        lambda at: at["most"],
    )


_LEAF_LIST = "array<struct<path:array<string>,node:variant>>"


def _opened(nodes: Column) -> Column:
    """The nodes with every object replaced by its members."""
    def members(at):
        below = lambda m: F.struct(F.array_append(at["path"], m["key"]).alias("path"), m["value"].alias("node"))
        inner = _children(at["node"])
        return F.when(inner.isNotNull(), F.transform(F.map_entries(inner), below)).otherwise(F.array(at))

    return F.flatten(F.transform(nodes, members))


def flatten_leaves(docs: DataFrame, doc: str = "doc", max_depth: int | None = None) -> DataFrame:
    """One row per leaf, without a shuffle and in one pass.

    Each row opens its own document, as many levels as that document has, so nothing about other
    documents must be known before. With ``max_depth`` a document that is nested deeper fails the
    query instead of losing leaves. A null ``doc`` has no leaves.
    """
    keep = [c for c in docs.columns if c != doc]
    depth = nesting_depth(doc)
    if max_depth is not None:
        depth = F.least(depth, F.lit(max_depth))
    levels = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    root = F.array(F.struct(F.array().cast("array<string>").alias("path"), F.col(doc).alias("node"))).cast(_LEAF_LIST)
    leaves = F.reduce(levels, root, lambda nodes, _: _opened(nodes))
    out = docs.filter(F.col(doc).isNotNull()).select(*keep, F.explode(leaves).alias("_leaf"))
    node = F.col("_leaf.node")
    value = F.to_json(node)
    if max_depth is not None:
        too_deep = F.raise_error(F.lit(f"document is nested deeper than {max_depth} levels"))
        value = F.when(_children(node).isNotNull(), too_deep.cast("string")).otherwise(value)
    return out.select(*keep, F.col("_leaf.path").alias("path"), value.alias("value"))


def leaf_name(path: ColumnOrName = "path") -> Column:
    """Dotted name of a leaf for display."""
    return F.array_join(as_col(path), ".")


def scalar_text(value: ColumnOrName = "value") -> Column:
    """Leaf value without JSON quoting; JSON null is null."""
    return F.try_variant_get(F.try_parse_json(as_col(value)), "$", "string")


def smart_lookup(leaves: DataFrame, keys: list[str], names: dict[str, str], roots: list[str], full_root: str, default: dict[str, str] | None = None) -> DataFrame:
    """Look names up in every document; one output column per name.

    ``names`` maps an output column to a dotted name. A name that starts with ``full_root``
    is a full path. Any other is tried below each of ``roots`` in order, and then anywhere
    by its last parts; among several such places the shallowest, then the smallest path wins.
    """
    def rank(name):
        parts = name.split(".")
        if name.split(".")[0] == full_root:
            return F.when(F.col("path") == _texts(parts), F.lit(0))
        out = F.when(F.slice("path", -len(parts), len(parts)) == _texts(parts), F.lit(len(roots)))
        out = F.when(F.size("path") >= len(parts), out)
        for i in reversed(range(len(roots))):
            out = F.when(F.col("path") == _texts(roots[i].split(".") + parts), F.lit(i)).otherwise(out)
        return out

    def found(out, name):
        r = rank(name)
        place = F.when(r.isNotNull(), F.struct(r.alias("r"), F.size("path").alias("d"), F.col("path").alias("p")))
        value = F.min_by(scalar_text(), place)
        fallback = (default or {}).get(out)
        return (value if fallback is None else F.coalesce(value, F.lit(fallback))).alias(out)

    return leaves.groupBy(*keys).agg(*[found(o, n) for o, n in names.items()])


def _texts(parts) -> Column:
    return F.array(*[F.lit(p) for p in parts])


def names_table(spark: SparkSession, names: Sequence[str], name: str) -> DataFrame:
    """A few names as a table that Spark knows to be small.

    Of ``createDataFrame`` it knows no size, and would rather send all leaves to the driver.
    """
    return spark.range(1).select(F.explode(_texts(names)).alias(name))


def list_children(leaves: DataFrame, keys: list[str], name: str, root: str, fallback: str) -> DataFrame:
    """What lies under a name: child names of a section, or the value of a single setting.

    The name is looked up below ``root`` and, where a document has nothing there, below
    ``root.fallback``. A dotted name that leads to a section is one record; its leaves are
    returned with their values.
    """
    asked = names_table(leaves.sparkSession, [name], "_asked")
    return list_children_of(leaves, keys, asked, "_asked", root, fallback).drop("_asked")


def _proper_prefixes(path: Column) -> Column:
    none = F.array().cast("array<array<string>>")
    lengths = F.sequence(F.lit(0), F.size(path) - 1)
    return F.when(F.size(path) > 0, F.transform(lengths, lambda n: F.slice(path, F.lit(1), n))).otherwise(none)


def merge_layers(leaves: DataFrame, keys: list[str], layer: str = "layer") -> DataFrame:
    """Deep merge of all layers of a document: objects merge, anything else the later layer wins.

    Per path the last layer wins, an explicit null included. A plain value of a later layer
    removes what earlier layers hold below it, and anything a later layer holds below an
    earlier plain value removes that value. All conditions are equalities on path prefixes.

    Values cross one shuffle, which brings together what all layers say at and below a place.
    Plain values with something below them come from the same places, without the values, and
    meet the leaves by the prefixes of their paths; the answer has only the leaves under them.
    No document is brought into one task.
    """
    number = leaves.schema[layer].dataType
    # One value for all keys, so that a null key equals another one and joins keep the partitioning.
    doc = F.struct(*keys) if keys else F.struct(F.lit(0))
    # One row per leaf, and one for every place above it that only says something lies below.
    own = F.struct("path", F.col(layer).alias("own"), "value", F.lit(None).cast(number).alias("below"))
    above = F.transform(
        _proper_prefixes(F.col("path")),
        lambda p: F.struct(
            p.alias("path"), F.lit(None).cast(number).alias("own"), F.lit(None).cast("string").alias("value"), F.col(layer).alias("below")
        ),
    )
    places = leaves.select(doc.alias("_doc"), F.explode(F.concat(F.array(own), above)).alias("p")).select("_doc", "p.*")
    # The path comes out of the aggregate too, so that no filter on it is tried on the added rows.
    tree = places.groupBy("_doc", F.col("path").alias("_at")).agg(
        F.first(F.when(F.col("own").isNotNull(), F.col("path")), ignorenulls=True).alias("path"),
        F.max_by("value", "own").alias("value"),
        F.max("own").alias("_layer"),
        F.max(F.when(F.col("value") != EMPTY_OBJECT, F.col("own"))).alias("_plain"),
        F.max("below").alias("_below"),
    )
    last = tree.filter(F.col("_layer").isNotNull())

    # Plain values that have, or once had, something below them; there are few.
    killers = tree.filter(F.col("_plain").isNotNull() & F.col("_below").isNotNull())
    killers = killers.select("_doc", F.col("_at").alias("_above"), F.col("_plain").alias("_kill"))
    spread = leaves.select(doc.alias("_doc"), F.col("path").alias("_at"), F.explode(_proper_prefixes(F.col("path"))).alias("_above"))
    # Estimates come from the files and know nothing of what is exploded from their rows, so they would
    # send a side to the driver that holds far more. Both joins are told to stay in the tasks.
    under = lookup_join(spread, killers.hint("merge"), ["_doc", "_above"], "inner").groupBy("_doc", "_at").agg(F.max("_kill").alias("_kill"))
    under = under.withColumnsRenamed({"_doc": "_under_doc", "_at": "_under_at"})
    told = last.join(under.hint("merge"), (F.col("_doc") == F.col("_under_doc")) & (F.col("_at") == F.col("_under_at")), "left")

    alive = F.coalesce(F.col("_kill") <= F.col("_layer"), F.lit(True))
    replaced = F.coalesce(F.col("_below") > F.col("_layer"), F.lit(False))
    # An empty object is a leaf only while nothing is left below it. The latest leaf below stays unless
    # a later plain value at or above the object removes it; and if that one goes, all others do.
    cleared = F.coalesce(F.col("_below") < F.greatest("_plain", "_kill"), F.lit(False))
    stays = F.when(F.col("value") == EMPTY_OBJECT, F.col("_below").isNull() | cleared).otherwise(~replaced)
    kept = told.filter(alive & stays)
    return kept.select(*[F.col("_doc").getField(k).alias(k) for k in keys], "path", "value")


def set_path(leaves: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Set nested values, creating what is missing above them: the changes are the top layer."""
    both = leaves.withColumn("layer", F.lit(0)).unionByName(changes.withColumn("layer", F.lit(1)))
    return merge_layers(both, keys)


def leaves_to_record(leaves: DataFrame, keys: list[str], depth: int, fields: list[str]) -> DataFrame:
    """One row per record with its named fields as a map; fields it does not have are left out.

    ``depth`` is the number of path parts above the fields.
    """
    field = F.try_element_at("path", F.lit(-1))
    own = leaves.filter(F.size("path") == depth + 1)
    row = own.groupBy(*keys).agg(*[F.max(F.when(field == f, scalar_text())).alias("_f_" + f) for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), F.col("_f_" + f).alias("value")) for f in fields])
    return row.select(*keys, F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())).alias("record"))


def _quoted(key: Column) -> Column:
    """A key as JSON text."""
    text = F.to_json(F.array(key))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def rebuild_documents(leaves: DataFrame, keys: list[str], depth: int = 0, out: str = "text") -> DataFrame:
    """Whole documents back from their leaves, as JSON text in ``out``; the opposite of ``flatten_leaves``.

    Names are sorted. Explicit nulls, empty objects and arrays come back as they were. A single
    leaf at the root is the whole document. With ``depth`` every place at that depth is a row of
    its own, named by ``path``: for registries that are too large for one text.

    The leaves of a document are sorted by path, so that what belongs together stands together,
    and each one writes only what differs from the leaf before it: the objects that end, those
    that begin, its name and value. One shuffle, whatever the depth. A place with a value and
    something below it, or with two values, is no document and fails; merge layers first.
    """
    rows = leaves.select(*keys, "path", F.coalesce("value", F.lit("null")).alias("value"))
    by = list(keys)
    if depth:
        rows = rows.select(
            *keys, F.slice("path", 1, depth).alias("_place"), F.slice("path", depth + 1, F.greatest(F.size("path") - depth, F.lit(0))).alias("path"), "value"
        )
        by.append("_place")
    w = W.partitionBy(*by).orderBy("path")
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag("path").over(w))
    size, before = F.size("path"), F.col("_before")
    shorter = F.least(F.size(before), size)
    same = F.filter(F.sequence(F.lit(1), shorter), lambda i: F.slice(before, F.lit(1), i) == F.slice(F.col("path"), F.lit(1), i))
    shared = F.when(before.isNotNull() & (shorter > 0), F.size(same)).otherwise(0)
    rows = rows.withColumn("_shared", shared)
    ended = F.when(before.isNull(), F.lit("")).otherwise(F.concat(F.repeat(F.lit("}"), F.size(before) - 1 - F.col("_shared")), F.lit(",")))
    begun = F.transform(F.slice("path", F.col("_shared") + 1, size - 1 - F.col("_shared")), lambda k: F.concat(_quoted(k), F.lit(":{")))
    named = F.concat(ended, F.array_join(begun, ""), _quoted(F.element_at("path", -1)), F.lit(":"), F.col("value"))
    clash = F.raise_error(F.concat(F.lit("a value and a setting below it, or two values, at "), F.array_join(before, "."))).cast("string")
    piece = F.when(before.isNotNull() & (F.col("_shared") == F.size(before)), clash).when(size == 0, F.col("value")).otherwise(named)
    rows = rows.select(*by, F.struct("_n", piece.alias("_text")).alias("_piece"), size.alias("_size"))
    done = rows.groupBy(*by).agg(F.sort_array(F.collect_list("_piece")).alias("_pieces"), F.max_by("_size", F.col("_piece._n")).alias("_open"))
    text = F.array_join(F.col("_pieces._text"), "")
    whole = F.when(F.col("_open") == 0, text).otherwise(F.concat(F.lit("{"), text, F.repeat(F.lit("}"), F.col("_open"))))
    return done.select(*keys, *([F.col("_place").alias("path")] if depth else []), whole.alias(out))


def _asked_places(asked: DataFrame, name: str, roots: list[list[str]], full_root: str | None, anywhere: bool) -> DataFrame:
    """``_name, _rank, _place, _parts, _last`` of asked names: where each may be found, best place first."""
    parts = F.split(name, r"\.")

    def place(rank, path):
        return F.struct(F.lit(rank).alias("_rank"), path.alias("_place"))

    tried = [place(i, F.concat(_texts(root), parts)) for i, root in enumerate(roots)]
    if anywhere:
        tried.append(place(len(roots), F.lit(None).cast("array<string>")))
    places = F.array(*tried)
    if full_root is not None:
        places = F.when(parts[0] == full_root, F.array(place(0, parts))).otherwise(places)
    names = asked.select(F.col(name)).filter(F.col(name).isNotNull()).distinct()
    return names.select(F.col(name).alias("_name"), F.explode(places).alias("p"), parts.alias("_parts"), F.element_at(parts, -1).alias("_last")).select("_name", "p.*", "_parts", "_last")


def _leaves_below(leaves: DataFrame, keys: list[str], places: DataFrame) -> DataFrame:
    """``keys, _name, path, value`` of all leaves at or below the best place of each name; ``path`` starts there.

    Every leaf meets the names by the last part of each of its prefixes: an equi-join with the
    table of names, which reads the leaves in the same way for any number of names.
    """
    steps = F.when(F.size("path") > 0, F.sequence(F.lit(1), F.size("path")))
    ends = leaves.select(*keys, "path", "value", F.explode(steps).alias("_n")).withColumn("_last", F.get("path", F.col("_n") - 1))
    met = ends.join(places.withColumnRenamed("_last", "_asked_last"), F.col("_last") == F.col("_asked_last"))
    here = F.slice("path", F.lit(1), F.col("_n"))
    fits = F.when(F.col("_place").isNotNull(), here == F.col("_place")).otherwise(
        (F.col("_n") >= F.size("_parts")) & (F.slice("path", F.greatest(F.col("_n") - F.size("_parts") + 1, F.lit(1)), F.size("_parts")) == F.col("_parts"))
    )
    hits = met.filter(fits).select(*keys, "_name", F.struct("_rank", "_n", here.alias("_here")).alias("_at"), "path", "value")
    best = hits.groupBy(*keys, "_name").agg(F.min("_at").alias("_at"))
    chosen = lookup_join(hits, best, [*keys, "_name", "_at"], "left_semi")
    n = F.col("_at._n")
    return chosen.select(*keys, "_name", F.slice("path", n + 1, F.size("path") - n).alias("path"), "value")


def lookup_settings(leaves: DataFrame, keys: list[str], asked: DataFrame, name: str, roots: list[str], full_root: str) -> DataFrame:
    """``keys, name, value, is_section`` of every asked name that a document has, settings and sections alike.

    ``asked`` is a table of dotted names. As in ``smart_lookup``, a name that starts with
    ``full_root`` is a full path; any other is tried below each of ``roots`` in order and then anywhere
    by its last parts, the shallowest and then the smallest path first. A section comes as JSON text
    with sorted names, a setting without JSON quoting; a JSON null is a null value.
    """
    places = _asked_places(asked, name, [r.split(".") for r in roots], full_root, anywhere=True)
    found = _leaves_below(leaves, keys, places)
    texts = rebuild_documents(found, [*keys, "_name"], out="_text")
    section = F.startswith(F.col("_text"), F.lit("{"))
    value = F.when(section, F.col("_text")).otherwise(scalar_text("_text"))
    return texts.select(*keys, F.col("_name").alias(name), value.alias("value"), section.alias("is_section"))


def list_children_of(leaves: DataFrame, keys: list[str], asked: DataFrame, name: str, root: str, fallback: str) -> DataFrame:
    """``list_children`` for a table of names: ``keys, name, child, value`` for all of them in one pass."""
    base = root.split(".")
    places = _asked_places(asked, name, [base, [*base, fallback]], None, anywhere=False)
    rows = _leaves_below(leaves, keys, places).withColumnRenamed("_name", name)
    dotted = F.col(name).contains(".")
    below = F.nullif(F.array_join("path", "."), F.lit(""))
    at_leaf = F.size("path") == 0
    whole = rows.filter(dotted).select(*keys, name, below.alias("child"), scalar_text().alias("value"))
    names = rows.filter(~dotted).select(*keys, name, F.get("path", F.lit(0)).alias("child"), F.when(at_leaf, scalar_text()).alias("value"))
    names = names.filter(F.col("child").isNotNull() | F.col("value").isNotNull()).distinct()
    return whole.unionByName(names)
