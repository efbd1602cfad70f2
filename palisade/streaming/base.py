"""Running streams whose batches are processed as ordinary DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palisade.sources.events import _fs

Batch = Callable[[DataFrame, int], None]


def run_batches(stream: DataFrame, process: Batch, checkpoint: str, *, trigger: dict | None = None, mode: str = "append"):
    """Start ``stream`` with ``foreachBatch``; by default everything available is processed and the query ends."""
    query = (
        stream.writeStream.foreachBatch(process).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    if trigger is None:
        query.awaitTermination()
    return query


def batch_path(root: str, batch_id: int) -> str:
    return f"{root}/batch={batch_id}"


def append_batch(df: DataFrame, root: str, batch_id: int) -> None:
    """Write a batch's output; a retry of the batch replaces it."""
    df.write.mode("overwrite").parquet(batch_path(root, batch_id))


def publish_batch(df: DataFrame, root: str, batch_id: int) -> bool:
    """Write a batch's output under another name and rename it into place, for folders that another stream reads; what a first attempt published stays."""
    spark, path = df.sparkSession, batch_path(root, batch_id)
    fs, final, hadoop = _fs(spark, path)
    if fs.exists(final):
        return False
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    df.write.parquet(draft)
    return fs.rename(hadoop.Path(draft), final)


def read_output(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Everything the batches wrote (empty when none ran)."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/batch=*")
