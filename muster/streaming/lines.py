"""Stream of log lines, cut down to those that match."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from muster import fixed_values as fv
from muster.operators.aggregates import any_pattern


def follow_matches(lines: DataFrame, patterns=fv.READY_PATTERNS, line: str = "line") -> DataFrame:
    return lines.filter(F.col(line).rlike(any_pattern(patterns)))
