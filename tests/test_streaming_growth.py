"""Keyed streams: what a row and a key of a micro-batch cost does not grow with what was there before."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.session import scratch_dir
from palisade.streaming import dedupe, keyed
from palisade.streaming.base import read_output


def test_once_only_needs_no_python(spark):
    """The first rows of keys are a streaming aggregate, combined before the shuffle; keys that come again in later micro-batches, earlier in time, stay out."""
    root = scratch_dir(spark, "once")
    schema = "k string, ts timestamp, seq long"
    parts = [[("a", 5, 2), ("a", 5, 1), ("a", 5, None), ("b", 9, 3), (None, 1, 4)], [("a", 1, 5), ("c", 7, 6), ("c", 7, 7), ("b", 9, 8)], [("c", 2, 9), ("d", 3, None)]]
    for part in parts:
        rows = spark.createDataFrame(part, "k string, t long, seq long").select("k", F.timestamp_seconds("t").alias("ts"), "seq")
        rows.write.mode("append").parquet(f"{root}/input")
        dedupe.once_only_stream(spark.readStream.schema(schema).parquet(f"{root}/input"), "k", "ts", "seq", output=f"{root}/output", checkpoint=f"{root}/checkpoint")
    got = read_output(spark, f"{root}/output", rows.schema).select("k", F.unix_seconds("ts"), "seq").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 5, 1), ("b", 9, 3), ("c", 7, 6), ("d", 3, None)]
    plan = keyed.first_ever(spark.readStream.schema(schema).parquet(f"{root}/input"), F.col("k"), "ts", "seq")._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan


class Kept:
    """A value or list state that counts how often it is read."""

    def __init__(self):
        self.value, self.reads, self.writes = None, 0, 0

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.value = value


class Listed(Kept):
    def get(self):
        self.reads += 1
        return iter(list(self.value or []))

    def put(self, rows):
        self.value = list(rows)

    def appendList(self, rows):
        self.writes += len(rows)
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Kept())

    def getListState(self, name, schema):
        return self.states.setdefault(name, Listed())

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_rows_are_not_read_again():
    """A micro-batch whose rows all have to wait adds one entry and reads none; a release gives the order of times."""
    handle, order = Handle(), keyed.InOrder()
    order.init(handle)
    waiting = handle.states["waiting"]
    for i in (3, 1, 2):
        rows = [("k", i * 1000 + j, j, None, f"{i}-{j}") for j in (1, 0)]
        assert list(order.handleInputRows(("k",), iter(rows), Watermark(0))) == []
    assert (waiting.reads, waiting.writes) == (0, 3)
    out = list(order.handleExpiredTimer(("k",), Watermark(2), None))
    assert [(r.payload, r.previous) for r in out] == [("1-0", None), ("1-1", "1-0"), ("2-0", "1-1")]
    out = list(order.handleInputRows(("k",), iter([("k", 2500, None, None, "late")]), Watermark(9)))
    assert [(r.payload, r.previous) for r in out] == [("2-1", "2-0"), ("late", "2-1"), ("3-0", "late"), ("3-1", "3-0")]
    assert list(order.handleExpiredTimer(("k",), Watermark(9), None)) == []
