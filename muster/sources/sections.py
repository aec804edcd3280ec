"""Host-sectioned key and value files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from muster import fixed_values as fv
from muster.functions.common import ColumnOrName
from muster.functions.text import strip
from muster.operators.ordered import fill_section
from muster.sources.logs import read_logs

_HEADER = r"(?i)^host\s+(.+)$"


def section_header(line: ColumnOrName) -> Column:
    return F.nullif(strip(F.regexp_extract(strip(line), _HEADER, 1)), F.lit(""))


def section_entries(lines: DataFrame, lines_per_bucket: int = 50_000) -> DataFrame:
    """``file, section, attr, value, line_no`` of every setting line.

    ``lines`` is ``file, line_no, line``. Blank lines and comments are skipped, a header
    opens a section, and a setting is split once at white space or ``=``. Names compare
    without regard to case, so they are returned in lower case.
    """
    filled = fill_section(lines, section_header("line"), ["file"], "line_no", lines_per_bucket)
    text = strip("line")
    pair = F.split(text, rf"[{fv.SPACE}=]+", 2)
    setting = (text != "") & ~text.startswith("#") & section_header("line").isNull() & (F.size(pair) > 1)
    return filled.filter(setting).select(
        "file",
        F.lower("section").alias("section"),
        F.lower(pair[0]).alias("attr"),
        strip(pair[1]).alias("value"),
        "line_no",
    )


def first_entries(entries: DataFrame) -> DataFrame:
    """First value of every attribute of every section."""
    return entries.groupBy("file", "section", "attr").agg(F.min_by("value", "line_no").alias("value"))


def read_sections(spark: SparkSession, paths) -> DataFrame:
    return section_entries(read_logs(spark, paths))
