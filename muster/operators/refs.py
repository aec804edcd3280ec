"""References into section files, written ``{path:Section.Attr}`` inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from muster.functions.common import as_col, join_on, lookup_join

_ANY_SLOT = r"\{([^}]+)\}"
_SLOT_CUT = r"\{[^}]+\}"


def refs_in(text) -> Column:
    """Distinct references of a text: a colon, and a path that starts with ``~`` or has a slash."""
    slots = F.array_distinct(F.regexp_extract_all(as_col(text), F.lit(_ANY_SLOT), F.lit(1)))
    return F.filter(slots, lambda r: F.contains(r, F.lit(":")) & (r.startswith("~") | F.contains(r, F.lit("/"))))


def _split_ref(ref: Column) -> dict[str, Column]:
    colon = F.locate(":", ref)
    look = F.substr(ref, colon + 1)
    dot = F.locate(".", look)
    return {
        "file": F.substr(ref, F.lit(1), colon - 1),
        "section": F.when(dot > 0, F.lower(F.substr(look, F.lit(1), dot - 1))),
        "attr": F.lower(F.when(dot > 0, F.substr(look, dot + 1)).otherwise(look)),
    }


def look_up_refs(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """Value of every distinct ``ref``; null where the file, section or attribute is missing.

    ``sections`` has ``file, section, attr, value, line_no``. A reference without a section
    takes the first line of the file with that attribute.
    """
    asked = refs.select("ref").distinct()
    asked = asked.select("ref", *[c.alias(n) for n, c in _split_ref(F.col("ref")).items()])
    lines = sections.select("file", F.lower("section").alias("section"), F.lower("attr").alias("attr"), "value", "line_no")
    named = lines.filter(F.col("section").isNotNull())
    anywhere = lines.withColumn("section", F.lit(None).cast("string"))
    first = (
        named.unionByName(anywhere)
        .groupBy("file", "section", "attr")
        .agg(F.min_by("value", "line_no").alias("value"))
    )
    return join_on(asked, first, ["file", "section", "attr"], "left").select("ref", "value")


def resolve_refs(df: DataFrame, text: str, sections: DataFrame) -> DataFrame:
    """Put the looked-up value in place of every reference; what is not found stays as written.

    Rows with the same references share one lookup: each distinct set is resolved once and
    joined back, however many rows have it.
    """
    rows = df.withColumn("_refs", refs_in(text))
    # The outer form keeps Spark from testing the pattern once more in a pushed-down filter.
    used = rows.select("_refs").distinct().select("_refs", F.explode_outer("_refs").alias("ref"))
    used = used.filter(F.col("ref").isNotNull())
    found = (
        lookup_join(used, look_up_refs(used, sections), ["ref"])
        .filter(F.col("value").isNotNull())
        .groupBy("_refs")
        .agg(F.collect_list(F.struct("ref", "value")).alias("_found"))
    )
    # The text is cut at its slots once, so a slot inside a value that was put in stays as it is.
    between = F.split(F.col(text), _SLOT_CUT, -1)
    slots = F.regexp_extract_all(F.col(text), F.lit(_ANY_SLOT), F.lit(1))
    values = F.map_from_entries("_found")
    put_in = F.transform(slots, lambda r: F.coalesce(values[r], F.concat(F.lit("{"), r, F.lit("}"))))
    filled = F.array_join(F.zip_with(between, F.array_append(put_in, F.lit("")), lambda a, b: F.concat(a, b)), "")
    joined = lookup_join(rows, found, ["_refs"])
    return joined.withColumn(text, F.coalesce(filled, F.col(text))).select(*df.columns)
