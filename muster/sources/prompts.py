"""Prompts from files or given inline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from muster import fixed_values as fv
from muster.functions.common import set_or_null
from muster.functions.text import strip


def read_prompts(spark: SparkSession, paths) -> DataFrame:
    """``source, prompt``: every file is one prompt."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source"), strip("value").alias("prompt"))


def choose_prompt(df: DataFrame, keys: list[str], file_text: str, inline: str) -> DataFrame:
    """File text, cut at both ends, or else the inline text; a row with neither gets an error."""
    from_file = F.col(file_text).isNotNull()
    prompt = F.when(from_file, strip(file_text)).otherwise(set_or_null(inline))
    return df.select(
        *keys,
        prompt.alias("prompt"),
        F.when(prompt.isNull(), F.lit(fv.NO_PROMPT)).alias("error"),
    )
