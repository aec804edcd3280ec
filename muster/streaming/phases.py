"""Stream of phase edges: start and stop are paired as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from muster.operators.aggregates import with_seconds

_CHANGE = "run string, phase string, started timestamp, stopped timestamp, batch bigint"


def phase_stream(edges: DataFrame, run: str, phase: str, edge: str, ts: str, keep: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Streaming first start and last stop of every phase, to be run in update mode.

    State is held per phase and window of length ``keep``, and dropped once the watermark has
    passed the window, so it stays bounded. A phase that crosses a window border is put
    together again by ``current_spans``: first and last edge combine without loss. Edges of a
    batch are combined before they are shuffled.
    """
    rows = edges.select(
        F.col(run).cast("string").alias("run"),
        F.col(phase).cast("string").alias("phase"),
        F.col(edge).alias("edge"),
        F.col(ts).cast("timestamp").alias("ts"),
    ).filter(F.col("edge").isin("start", "stop"))
    return (
        rows.withWatermark("ts", delay)
        .groupBy("run", "phase", F.window("ts", keep))
        .agg(
            F.min(F.when(F.col("edge") == "start", F.col("ts"))).alias("started"),
            F.max(F.when(F.col("edge") == "stop", F.col("ts"))).alias("stopped"),
        )
        .drop("window")
    )


def store_changes(spans: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the phases each batch has changed; doing a batch again replaces its own rows."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        spans.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Phases as they stand: starts only move down and stops only up. Open ones have no seconds."""
    spans = _read(spark, folder, _CHANGE).groupBy("run", "phase").agg(F.min("started").alias("started"), F.max("stopped").alias("stopped"))
    return with_seconds(spans)


_MARK = "newest timestamp"
_LATE = "run string, phase string, edge string, ts timestamp, behind timestamp, batch bigint"


def follow_phases(edges: DataFrame, run: str, phase: str, edge: str, ts: str, folder: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Pair the edges of a stream batch by batch, and list those that come too late.

    An edge is late when its time lies more than ``delay`` before the newest time of all earlier
    batches, as a watermark would have it. Late edges change no phase; ``late_edges`` lists them with
    the time they were behind of. The phases are read by ``current_spans`` from ``folder/spans``.

    A batch writes its own spans, its late edges and the newest time so far, each in a folder
    named by the batch: doing it again gives the same rows. No state is held between batches but that time.
    Edges other than start and stop are left out; a null time is on time and pairs nothing.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = df.select(
            F.col(run).cast("string").alias("run"),
            F.col(phase).cast("string").alias("phase"),
            F.col(edge).alias("edge"),
            F.col(ts).cast("timestamp").alias("ts"),
        ).filter(F.col("edge").isin("start", "stop"))
        before = _read(spark, f"{folder}/marks/batch={batch_id - 1}", _MARK).first()
        newest = before["newest"] if before else None
        mark = F.lit(newest).cast("timestamp") - F.expr(f"interval {delay}")
        rows = rows.withColumn("behind", mark).withColumn("late", F.coalesce(F.col("ts") < mark, F.lit(False))).persist()
        try:
            spans = rows.filter(~F.col("late")).groupBy("run", "phase").agg(
                F.min(F.when(F.col("edge") == "start", F.col("ts"))).alias("started"),
                F.max(F.when(F.col("edge") == "stop", F.col("ts"))).alias("stopped"),
            )
            spans.write.mode("overwrite").parquet(f"{folder}/spans/batch={batch_id}")
            rows.filter("late").drop("late").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
            now = rows.agg(F.greatest(F.max("ts"), F.lit(newest).cast("timestamp")).alias("newest"))
            now.write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")
        finally:
            rows.unpersist()

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_edges(spark: SparkSession, folder: str) -> DataFrame:
    """``run, phase, edge, ts, behind, batch`` of all edges that came too late for ``follow_phases``."""
    return _read(spark, f"{folder}/late", _LATE)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
