"""Log files as numbered lines, in batch and as a stream."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def read_logs(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """``file, line_no, line`` of text files of any size, ``line_no`` counted from 1.

    Files are read in splits. The task that reads a split numbers its lines as it goes, and the
    number of lines in earlier splits of the file is added from a table with one row per split,
    so a huge file never becomes one task or one row, and no text is sorted.
    """
    raw = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", str(recursive).lower())
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_at"),
            F.col("value").alias("line"),
        )
    )
    sizes = raw.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_lines"), F.min("_at").alias("_first"))
    before = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    inside = F.col("_at") - F.col("_first")
    lost = F.raise_error(F.lit("a file was split differently while its lines were counted")).cast("bigint")
    same = (inside >= 0) & (inside < F.col("_lines"))
    return raw.join(offsets, ["file", "_start"], "left").select(
        "file", F.when(same, F.col("_before") + inside + 1).otherwise(lost).alias("line_no"), "line"
    )


def text_to_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Lines of texts that are already in a column."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.withColumn("line_no", (F.col("line_no") + 1).cast("bigint"))


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Streaming ``file, line`` of a folder of rotated log files; every file is read once."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def write_log_files(lines: DataFrame, folder: str, file: str, order: list[str], line: str) -> None:
    """One text file per name below ``folder``, its lines in order; a file that is there is replaced.

    The lines of a file pass through one task, a batch at a time. Names may hold no folders.
    """
    rows = lines.select(F.col(file).alias("file"), F.col(line).alias("line"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    rows = rows.repartition("file").sortWithinPartitions("file", *[f"_o{i}" for i in range(len(order))]).select("file", "line")

    def write(batches):
        from muster.sources.follow import open_for_writing

        name, out, written = None, None, 0
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != name:
                    if out is not None:
                        out.close()
                    name, out, written = file, open_for_writing(folder, file), written + 1
                out.write((text or "").encode() + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["files"])

    rows.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
