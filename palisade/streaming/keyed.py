"""Keyed state in Spark's own state store: deduplication with a time to live, last states in event-time order.

State lives in RocksDB and is checkpointed with the stream, so a micro-batch touches only the keys it meets; timers remove what has expired.  A row travels
through the operator as JSON, beside its time in microseconds and its sequence number.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def stored(stream: DataFrame) -> DataFrame:
    """The stream, with state kept in RocksDB."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream


def _packed(stream: DataFrame, key: Column, ts: str, seq: str, delay: str) -> DataFrame:
    """(key, at, seq, event time, payload) of the rows with a time.  Rows without a key, which become the key '', only move the watermark."""
    rows = stored(stream).filter(F.col(ts).isNotNull()).select(
        F.coalesce(key.cast("string"), F.lit("")).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(seq).cast("long").alias("seq"),
        F.col(ts).cast("timestamp").alias("time"), F.to_json(F.struct("*"), TIMES).alias("payload"))
    return rows.withWatermark("time", delay)


def _states(rows) -> Iterator[tuple]:
    """(at, seq, payload) of rows as ``_packed`` makes them."""
    return ((at, seq, payload) for _, at, seq, _, payload in rows)


def _order(row: tuple) -> tuple:
    """Time, then sequence number, rows without one last."""
    return row[0], row[1] is None, row[1] or 0


class Accept(StatefulProcessor):
    """Hands on a key's row if none was accepted before it, or the last accepted one is at least a time to live older.

    The state of a key is the time of its last accepted row.  Of the rows of a micro-batch only those are held that this does not already refuse."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not key[0]:
            return
        known = self.last.get()
        last = None if known is None else known[0]
        taken = []
        for at, seq, payload in sorted((r for r in _states(rows) if known is None or r[0] >= known[0] + self.ttl), key=_order):
            if last is None or at >= last + self.ttl:
                taken.append(Row(key=key[0], seq=seq, payload=payload))
                last = at
        if taken:
            self.last.update((last,))
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)
            yield from taken

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if known is not None and (known[0] + self.ttl) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def accepted(stream: DataFrame, key: Column, ts: str, seq: str, ttl_seconds: int, delay: str) -> DataFrame:
    """The rows of a stream that a time-to-live deduplication by ``key`` accepts.

    Time is event time.  Rows behind the watermark (``delay`` behind the newest row) are not looked at, as Spark drops them; within a micro-batch rows go
    by time, then ``seq``.  Keys expire when the watermark passes their last accepted row by the time to live."""
    packed = _packed(stream, key, ts, seq, delay)
    out = packed.groupBy("key").transformWithState(Accept(ttl_seconds * 1_000_000), "key string, seq long, payload string", "Append", "EventTime")
    return out.select(F.from_json("payload", stream.schema, TIMES).alias("r")).select("r.*")


class InOrder(StatefulProcessor):
    """Buffers a key's rows until the watermark has passed them, then hands each on with the payload before it, by time and sequence number.

    What a micro-batch brings for a key is one entry of the list that waits, written without reading the others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "payload string")
        self.waiting = handle.getListState("waiting", "at array<long>, seq array<long>, payload array<string>")

    def _wait(self, rows: list[tuple], write: Callable) -> None:
        write([tuple(map(list, zip(*rows)))])
        self.handle.registerTimer(min(at for at, _, _ in rows) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not key[0]:
            return
        rows, until = list(_states(rows)), timerValues.getCurrentWatermarkInMs() * 1000
        if min(at for at, _, _ in rows) > until:
            self._wait(rows, self.waiting.appendList)
        else:
            yield from self._release(key, rows, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._release(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _release(self, key, rows: list[tuple], until: int) -> Iterator[Row]:
        """Rows up to ``until`` (microseconds), of those given and those that wait, go out; the others wait for a timer."""
        held = [r for entry in self.waiting.get() for r in zip(*entry)]
        if not held and not rows:
            return
        rows = sorted([*held, *rows], key=_order)
        n = bisect_right(rows, until, key=itemgetter(0))
        if n == 0 and len(rows) == len(held):
            return
        if n < len(rows):
            self._wait(rows[n:], self.waiting.put)
        elif held:
            self.waiting.clear()
        if n:
            known = self.last.get()
            before = None if known is None else known[0]
            self.last.update((rows[n - 1][2],))
            for _, seq, payload in rows[:n]:
                yield Row(key=key[0], seq=seq, payload=payload, previous=before)
                before = payload

    def close(self) -> None:
        pass


def with_previous_in_order(stream: DataFrame, key: Column, ts: str, seq: str, delay: str) -> DataFrame:
    """Rows of a stream with ``previous``, the struct of the key's row before (null for the first), in event-time order whatever the order of arrival.

    A row waits in state until the watermark has passed it, so rows up to ``delay`` late find their place."""
    packed = _packed(stream, key, ts, seq, delay)
    out = packed.groupBy("key").transformWithState(InOrder(), "key string, seq long, payload string, previous string", "Append", "EventTime")
    return out.select(F.from_json("payload", stream.schema, TIMES).alias("r"), F.from_json("previous", stream.schema, TIMES).alias("previous")).select("r.*", "previous")


def first_ever(stream: DataFrame, key: Column, ts: str, seq: str) -> DataFrame:
    """The first row of each key of a stream, for output mode update.  Nothing expires and no row is too late; rows without a key or time are left out.

    A streaming aggregate, combined before the shuffle: of a key's first micro-batch it keeps the row of the least time and sequence number.  Update mode gives the
    keys that a micro-batch meets; a key that met one micro-batch only is new."""
    rows = stored(stream).filter(key.isNotNull() & F.col(ts).isNotNull()).select(
        key.cast("string").alias("key"), F.current_timestamp().alias("batch"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(seq).cast("long").alias("seq"), F.struct("*").alias("r"))
    first = rows.groupBy("key").agg(F.min_by("r", F.struct("batch", "at", F.col("seq").isNull(), "seq")).alias("r"), F.min("batch").alias("first"), F.max("batch").alias("last"))
    return first.filter(F.col("first") == F.col("last")).select("r.*")
