"""Streams of polls: report for every key the first hit, or that the polls ran out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from muster import fixed_values as fv

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Times are microseconds inside Python, so no session time zone can shift them.
_RESULT = "key string, status string, poll int, payload string, us bigint"
#: Status of a poll that came when its key may already have been forgotten.
LATE = "late"


def _place(poll: Row) -> tuple:
    """Order of the polls of a key: by time and number, those without last."""
    return (poll.us is None, poll.us or 0, poll.seq is None, poll.seq or 0)


class FirstHit(StatefulProcessor):
    """Counts the polls of one key; reports it once, at its first hit or when its polls or its time run out.

    The state is the number of polls, whether the key was reported, and when it is forgotten.
    A poll of an unknown key that is older than the whole time of a key may belong to one that
    was forgotten; it is reported as ``late`` instead of starting a new count.
    """

    def __init__(self, limit: int, seconds: float, good: str, bad: str):
        self.limit, self.micros, self.good, self.bad = limit, int(seconds * 1_000_000), good, bad

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "polls int, done boolean, until bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.seen.get()
        polls, done, until = held or (0, False, None)
        mark = timerValues.getCurrentWatermarkInMs()
        # Only the first polls can matter, so a key with any number of rows holds a few at a time.
        first, left = [], self.limit - polls
        for poll in rows:
            if held is None and poll.us is not None and (poll.us + self.micros) // 1000 <= mark:
                yield self._report(key, LATE, None, poll)
            elif not done:
                first.append(poll)
                if len(first) >= 2 * left:
                    first = sorted(first, key=_place)[:left]
        if not first:
            return
        first = sorted(first, key=_place)[:left]
        if until is None:
            until = (mark * 1000 if first[0].us is None else first[0].us) + self.micros
            self.handle.registerTimer(-(-until // 1000))
        hit = next((i for i, poll in enumerate(first) if poll.hit), None)
        polls += len(first)
        if hit is not None:
            yield self._report(key, self.good, polls - len(first) + hit + 1, first[hit])
        elif polls >= self.limit:
            yield self._report(key, self.bad)
        self.seen.update((polls, hit is not None or polls >= self.limit, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.seen.get()
        self.seen.clear()
        if held is not None and not held[1]:
            yield self._report(key, self.bad)

    def _report(self, key: tuple, status: str, number: int | None = None, poll: Row | None = None) -> Row:
        return Row(key=key[0], status=status, poll=number, payload=poll and poll.payload, us=poll and poll.us)

    def close(self) -> None:
        pass


def first_hits(polls: DataFrame, key: str, ts: str, seq: str, hit: Column, payload: Column, good: str, bad: str, limit: int, seconds: float, delay: str) -> DataFrame:
    """Stream of reports.

    No poll is dropped: the watermark only moves the timers, and its column does not reach the
    stateful step, so Spark has nothing to filter late rows by. A poll of a known key counts
    however late it is; one that may belong to a forgotten key comes out with status ``late``,
    its time and its payload. A poll without a time comes after all others of its batch.

    All polls of a key in one micro-batch pass through one task, one after the other. A key that
    may have very many is kept in bounds by the source's own limit of rows or files a batch.
    """
    rows = polls.select(
        F.col(key).cast("string").alias("key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(seq).cast("bigint").alias("seq"),
        F.coalesce(hit, F.lit(False)).alias("hit"),
        payload.cast("string").alias("payload"),
    )
    found = (
        rows.withColumn("ts", F.timestamp_micros("us"))
        .withWatermark("ts", delay)
        .select("key", "us", "seq", "hit", "payload")
        .groupBy("key")
        .transformWithState(FirstHit(limit, seconds, good, bad), _RESULT, "append", "eventTime")
    )
    return found.withColumn("ts", F.timestamp_micros("us")).drop("us")


def await_allocation(polls: DataFrame, key: str, ts: str, seq: str, node: Column, limit: int = fv.POLL_LIMIT, seconds: float = fv.POLL_LIMIT * fv.POLL_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """First usable node of every job, or a timeout after ``limit`` polls or ``seconds`` of event time."""
    return first_hits(polls, key, ts, seq, node.isNotNull(), node, "allocated", "timeout", limit, seconds, delay)


def await_ready(polls: DataFrame, key: str, ts: str, seq: str, ready: Column, limit: int = fv.POLL_LIMIT, seconds: float = fv.POLL_LIMIT * fv.POLL_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """First ready poll of every server, or a failure."""
    return first_hits(polls, key, ts, seq, ready, F.lit(None), "ready", "failed", limit, seconds, delay)
