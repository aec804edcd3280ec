"""Job listings of a scheduler, as pipe-separated text or as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from muster import fixed_values as fv
from muster.functions.text import strip

COLUMNS = ("job_id", "name", "state", "nodes")
_NODES = "array<struct<name:string>>"
_JOB = "struct<job_id:string,name:string,state:string,nodes:variant>"


def _is_job(parts: Column) -> Column:
    return F.size(parts) >= 4


def _job_of(parts: Column) -> Column:
    node = F.coalesce(F.nullif(parts[3], F.lit("")), F.lit(fv.UNKNOWN))
    return F.struct(
        parts[0].alias("job_id"),
        parts[1].alias("name"),
        parts[2].alias("state"),
        F.array(F.struct(node.alias("name"))).alias("nodes"),
    )


def parse_listing_text(lines: DataFrame, line: str = "value") -> DataFrame:
    """``id|name|state|node`` lines. Blank lines and lines with fewer than four parts are dropped."""
    parts = lines.select(F.split(strip(line), r"\|").alias("_p"))
    return parts.filter(_is_job(F.col("_p"))).select(_job_of(F.col("_p")).alias("j")).select("j.*")


def parse_listing_json(docs: DataFrame, doc: str = "value") -> DataFrame:
    """JSON listings: an array of jobs, an object with ``jobs``, or one job; anything else is read as text lines."""
    parsed = docs.select(F.col(doc).alias("_doc"), F.try_parse_json(strip(doc)).alias("_v"))
    one = F.try_variant_get("_v", "$", _JOB)
    listed = F.coalesce(
        F.try_variant_get("_v", "$", f"array<{_JOB}>"),
        F.try_variant_get("_v", "$.jobs", f"array<{_JOB}>"),
        F.when(one["job_id"].isNotNull(), F.array(one)),
    )
    parsed = parsed.select("_doc", listed.alias("_listed"))
    from_json = F.transform(
        "_listed",
        lambda j: F.struct(
            j["job_id"].alias("job_id"),
            j["name"].alias("name"),
            j["state"].alias("state"),
            F.try_variant_get(j["nodes"], "$", _NODES).alias("nodes"),
        ),
    )
    lines = F.transform(F.split("_doc", "\n"), lambda x: F.split(strip(x), r"\|"))
    from_text = F.transform(F.filter(lines, _is_job), _job_of)
    return parsed.select(F.explode(F.coalesce(from_json, from_text)).alias("j")).select("j.*")


def read_job_listing_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_listing_text(spark.read.text(path))


def read_job_listing_json(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """One JSON document per line, or per file with ``wholetext``."""
    return parse_listing_json(spark.read.text(path, wholetext=wholetext))
