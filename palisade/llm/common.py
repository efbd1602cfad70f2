"""Helpers shared by the corpus operators: hold-out rule, word patterns, staging, connected components."""

from __future__ import annotations

import functools
import re
import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.session import scratch_dir

# Fixed values of the word definitions: runs without ASCII white space; runs of letters, digits and non-ASCII.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of a table that may be broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 48 << 20


def fold(df: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(df.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is exact for texts of single-byte characters and much faster than ``translate``."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def spaced_words(text: str | None) -> list[bytes]:
    """Words of the white-space definition after lower-casing A-Z; bytes.split() splits at exactly that set."""
    return [] if text is None else text.encode().lower().split()


_local = threading.local()


def _written() -> list[str]:
    """Folders that this thread has staged, oldest first."""
    if not hasattr(_local, "paths"):
        _local.paths = []
    return _local.paths


def settled(name: str):
    """For a function that returns a DataFrame: the result is staged, and what the function staged on the way is deleted."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(*args, **kwargs):
            mark = len(_written())
            out = staged(fn(*args, **kwargs), name)
            spark, paths = out.sparkSession, _written()
            for path in paths[mark:-1]:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            del paths[mark:-1]
            return out

        return run

    return wrap


def staged(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The rows, written once below ``spark.checkpoint.dir`` and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}")
    _written().append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows_bytes: int, bound: int = BROADCAST_BYTES) -> bool:
    """Whether a table, counted, stays within the broadcast bound at ``rows_bytes`` per row."""
    return df.count() * rows_bytes <= bound


def small(df: DataFrame, rows_bytes: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast only if its counted rows prove that it is within the bound."""
    return F.broadcast(df) if is_small(df, rows_bytes, bound) else df


def with_documents(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join of what was found out about documents, keyed by doc_id (null matches null) and text hash h."""
    r = right.withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    return left.join(r, left["doc_id"].eqNullSafe(r["__id"]) & (left["h"] == r["__h"]), "left").drop("__id", "__h")


def union_length(spans: DataFrame, out: str) -> DataFrame:
    """(doc_id, h, out): number of words covered by the spans (start, end) of each document, overlaps counted once."""
    spans = spans.groupBy("doc_id", "h", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc_id", "h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    return spans.groupBy("doc_id", "h").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).alias(out))


class Forest:
    """Union-find over positions 0..n-1; the smallest position of a tree is its root."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


@settled("components")
def components(edges: DataFrame, staged_name: str = "cc") -> DataFrame:
    """(node, component) for every node of the edges (a, b: long); component is the smallest node reachable.

    Alternates the two star operations: every node links its larger neighbours to the smallest node it knows, then its
    smaller ones.  Both keep connectivity and never add edges; the number of rounds is logarithmic.  Each round is written to the
    shared folder.  A hub's edges are combined before the shuffle where its minimum is sought; where the minimum is
    joined back, the hub side is the left of a plain join, which the adaptive skew join may split.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = staged(now, staged_name)
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        star = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).filter("a <> b").distinct()
        now = staged(star, staged_name)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


@functools.cache
def pattern(text: str) -> re.Pattern:
    return re.compile(text)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
