"""Keyed last state: successive observations are compared across micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.plans.base import staged
from palisade.sources.commits import Store
from palisade.streaming.base import append_batch, run_batches
from palisade.streaming.keyed import with_previous_in_order


def diff_stream(
    stream: DataFrame, diff: Callable[[DataFrame, list[str]], DataFrame], *, output: str, checkpoint: str, delay: str = "1 day", trigger=None,
):
    """Change rows of a stream of states (asset_id, facet, observed_at, seq, current), paired in event-time order whatever the order of arrival.

    A state waits until the watermark, ``delay`` behind the newest one, has passed it; it is then compared with the one before it."""
    key = F.to_json(F.struct("asset_id", "facet"))
    paired = with_previous_in_order(stream.select("asset_id", "facet", "observed_at", F.col("seq").cast("long").alias("seq"), "current"), key, "observed_at", "seq", delay)
    paired = paired.withColumn("previous", F.col("previous.current"))
    return run_batches(paired, lambda batch, n: append_batch(diff(batch, ["asset_id", "facet", "seq"]), output, n), checkpoint, trigger=trigger)


def bucket_counts(stream: DataFrame, ts: str, keys: list[str], duration: str, delay: str) -> DataFrame:
    """Rows per tumbling bucket and key; the watermark bounds the state."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, duration).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("bucket"), *keys, "n")
    )


def upsert_stream(stream: DataFrame, name: str, key: list[str], store: Store, *, checkpoint: str, trigger=None):
    """Keep the latest value of each key of an update-mode aggregation in a table of the store; a batch rewrites the buckets of its keys only."""
    schema = stream.schema

    def process(batch: DataFrame, batch_id: int) -> None:
        if store.has(batch_id):
            return
        commit = store.batch(batch_id)
        commit.merge(name, schema, key, staged("upserts")(batch), lambda cur, new: cur.join(new.select(*key), key, "left_anti").select(*schema.names).unionByName(new))
        commit.commit()

    return run_batches(stream, process, checkpoint, trigger=trigger, mode="update")
