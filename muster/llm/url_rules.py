"""URL filters: block and allow rules on hosts and the beginnings of paths, by DataFrame functions only.

A URL is expanded into expressions, each a suffix of its host (whole labels) with a prefix of
its path (up to a slash). A rule is filed under its host and the part of its path up to the last
slash. Both sides are joined on the first bytes of the expression's SHA-256; the full digest and
what is left of the rule's path are compared afterwards. The longest rule that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from muster.functions.common import lookup_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("\u0000", host, path), 256))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, "[.]"))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _filed_path(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules with their digests; rules without a host, and null paths (taken as empty), included where they can fit."""
    host, path = F.translate(F.col("host"), _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    named = rules.filter("host is not null and host <> '' and verdict is not null").select(host.alias("rule_host"), path.alias("rule_path"), "verdict").distinct()
    filed = _filed_path(F.col("rule_path"))
    full = _digest(F.col("rule_host"), filed)
    return named.withColumns({"full": full, "short": F.substring(full, 1, 4), "labels": _labels(F.col("rule_host")), "slashes": _slashes(filed)})


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains of it, if the
    path begins with the rule's. The longest rule (host and path together) wins; of equally long
    ones the one with the longer host, then the first in the order of text; of the same rule
    with both verdicts ``block``. Without a rule ``rule`` is null and the verdict ``default``.

    A null URL, and one without ``://``, has an empty host and path and fits no rule. An empty
    rule table gives every URL the default. Repeated rows and null ids pass through; columns
    called like the new ones are replaced. Rules without a host fit nothing.
    """
    ready = prepared_rules(rules)
    # No suffix with more labels, and no prefix with more slashes, than any rule has can fit one.
    most = ready.agg(F.coalesce(F.max("labels"), F.lit(0)).alias("labels"), F.coalesce(F.max("slashes"), F.lit(0)).alias("slashes")).first()
    url = F.col(f"`{url_col}`").cast("string")
    new = ["host", "path", "rule", "verdict"]
    parsed = urls.withColumns({"_url_host": url_host(url), "_url_path": url_path(url)})
    distinct = parsed.select(F.col("_url_host").alias("host"), F.col("_url_path").alias("path")).filter("host <> ''").distinct()
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most["labels"]))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    parts = F.split(_filed_path(F.col("path")), "/")
    # Each prefix ends in a slash; the empty one is filed for rules without one.
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(most["slashes"]))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    expanded = distinct.filter(F.lit(most["labels"] > 0)).withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    looked = expanded.withColumn("full_url", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("full_url", 1, 4))
    hits = looked.join(ready, "short").filter((F.col("full_url") == F.col("full")) & (F.col("suffix") == F.col("rule_host")) & F.startswith("path", "rule_path"))
    text = F.concat("rule_host", "rule_path")
    # The largest of these structs is the rule that wins; ties by text go to the first, hence the minimum of the rest.
    rank = F.struct((-F.length(text)).alias("length"), (-F.length("rule_host")).alias("host_length"), text.alias("rule"), (F.col("verdict") != "block").alias("mild"), "verdict")
    best = hits.groupBy("host", "path").agg(F.min(rank).alias("best")).select(F.col("host").alias("_url_host"), F.col("path").alias("_url_path"), "best.rule", "best.verdict")
    kept = [c for c in parsed.columns if c not in new]
    joined = lookup_join(parsed.select(*[F.col(f"`{c}`") for c in kept]), best, ["_url_host", "_url_path"])
    return joined.select(*[F.col(f"`{c}`") for c in kept if c not in ("_url_host", "_url_path")], F.col("_url_host").alias("host"), F.col("_url_path").alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
