"""Keyed state tables, and import of a JSON state file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

STATE = "key string, pid bigint"


def parse_state(docs: DataFrame, doc: str = "value") -> DataFrame:
    """``key, pid`` of JSON objects; a broken document holds no entries."""
    entries = F.map_entries(F.from_json(doc, "map<string,bigint>"))
    return docs.select(F.explode(entries).alias("e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("pid"))


def import_state(spark: SparkSession, path: str) -> DataFrame:
    """State from a JSON file; a missing file is an empty state."""
    try:
        return parse_state(spark.read.text(path, wholetext=True))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def write_state(state: DataFrame, path: str) -> None:
    state.select("key", "pid").write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Stored state; nothing stored yet is an empty state."""
    try:
        return spark.read.schema(STATE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)
