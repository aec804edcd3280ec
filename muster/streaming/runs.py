"""Starting streams that take what is there and stop."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from muster.streaming.polls import ROCKSDB

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Stateful processors need the RocksDB state store; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input that is there, into a Parquet table below ``folder``."""
    spark = stream.sparkSession
    out = f"{folder}/out"
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start(out)
        )
        finish(query)
    return spark.read.schema(stream.schema).parquet(out)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
