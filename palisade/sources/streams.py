"""Given tables as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_stream(spark: SparkSession, folder: str, name: str, **options: str) -> DataFrame:
    """Stream of ``<folder>/<name>.parquet``, be it one file or a folder of files.  Pass ``maxFilesPerTrigger`` to bound
    the size of a micro-batch."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isFile()
    reader = spark.readStream.schema(schema).options(**options)
    if single:
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)
