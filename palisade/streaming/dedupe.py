"""Deduplication with and without expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.streaming.base import append_batch, run_batches
from palisade.streaming.keyed import accepted, first_ever


def dedupe_stream(stream: DataFrame, key: str, ts: str, seq: str, ttl_seconds: int, *, output: str, checkpoint: str, delay: str = "1 day", trigger=None):
    """Time-to-live deduplication of a stream into a table; see ``keyed.accepted``."""
    kept = accepted(stream, F.col(key), ts, seq, ttl_seconds, delay)
    return run_batches(kept, lambda batch, n: append_batch(batch, output, n), checkpoint, trigger=trigger)


def once_only_stream(stream: DataFrame, key: str, ts: str, seq: str, *, output: str, checkpoint: str, trigger=None):
    """The first row of each key ever, into a table; see ``keyed.first_ever``."""
    return run_batches(first_ever(stream, F.col(key), ts, seq), lambda batch, n: append_batch(batch, output, n), checkpoint, trigger=trigger, mode="update")
