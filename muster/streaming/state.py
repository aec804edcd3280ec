"""Keyed state kept by a stream of start and stop changes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from muster.operators.state import START, STOP
from muster.sources.keyed_state import STATE
from muster.streaming.runs import rocksdb_state

_CHANGED = STATE + ", here boolean, number bigint"


def _place(seq) -> tuple:
    """Order of a value or struct, nulls first."""
    return tuple(map(_place, seq)) if isinstance(seq, tuple) else (seq is not None, seq)


class Entry(StatefulProcessor):
    """The entry of one key; tells every time that it comes, goes or gets another process.

    The state is the process, whether the key is there, and how often it changed. It stays for
    a key that has gone, so that the numbers of its changes go on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "pid bigint, here boolean, number bigint")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.entry.update((initialState.pid, initialState.here, initialState.number))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        pid, here, number = self.entry.get() or (None, False, 0)
        # Only starts behind the last stop can matter.
        stop, starts = None, []
        for change in rows:
            place = _place(change.seq)
            if stop is not None and place <= stop:
                continue
            if change.op == STOP:
                stop, starts = place, [s for s in starts if s[0] > place]
            elif change.op == START:
                starts.append((place, change.pid))
        if here and stop is None:
            return
        now = (min(starts, key=_place)[1], True) if starts else (None, False)
        if now != (pid, here):
            self.entry.update((*now, number + 1))
            yield Row(key=key[0], pid=now[0], here=now[1], number=number + 1)

    def close(self) -> None:
        pass


def _last_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The last change of every key, over all runs."""
    try:
        told = spark.read.schema(_CHANGED).parquet(f"{folder}/run-*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CHANGED)
    last = told.groupBy("key").agg(F.max_by(F.struct("pid", "here", "number"), "number").alias("last"))
    return last.select("key", "last.*")


def current_state(spark: SparkSession, folder: str) -> DataFrame:
    """``key, pid`` of the keys that are there after the changes told so far."""
    return _last_changes(spark, folder).filter("here").select("key", "pid")


def entry_changes(changes: DataFrame, folder: str) -> DataFrame:
    """Stream of ``key, pid, here, number`` from one of ``key, op, pid, seq``, with a struct or number as ``seq``.

    Batches count in the order in which they come, and changes of one batch in that of ``seq``. A
    start of a key that is there is refused. A stream without a past begins with what ``folder`` tells.
    """
    before = _last_changes(changes.sparkSession, folder).groupBy("key")
    rows = changes.select("key", "op", F.col("pid").cast("bigint").alias("pid"), "seq")
    return rows.groupBy("key").transformWithState(Entry(), _CHANGED, "append", "none", before)


def upsert_state(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start the stream that adds what is there to the changes told in ``folder``.

    The state itself is Spark's own, one value per key, so a batch reads and writes only the keys it
    has; the table holds one row per change, written once by the file sink. A batch that is done
    again tells the same changes under the same numbers. A new checkpoint goes on from the table,
    and the one that it replaced must not be used any more.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    with rocksdb_state(changes.sparkSession):
        return (
            entry_changes(changes, folder)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(f"{folder}/run-{run}")
        )
