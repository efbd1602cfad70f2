"""Tables that change together: one manifest per batch.

A store is a folder of tables.  Keyed tables (one row per key) lie in buckets of their key's hash; a batch reads and rewrites only the buckets that its keys
fall into.  Event tables grow by one folder per batch.  Everything of a batch is written under names of its own and becomes visible at once, when its
manifest, which names the folders of every table, is renamed into place.  A batch that has a manifest is never written again, so a retry changes nothing, and
leftovers of failed attempts are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.sources.events import _fs

BUCKET = "__bucket"


class Store:
    """``buckets`` counts for tables that the store does not have yet."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def batches(self) -> list[int]:
        """Committed batches, oldest first."""
        fs, folder, _ = _fs(self.spark, f"{self.root}/_commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, batch: int | None = None) -> dict:
        """The manifest of a batch, by default the last one; an empty one for a new store."""
        if batch is None:
            done = self.batches()
            if not done:
                return {"keyed": {}, "events": {}, "replaced": []}
            batch = done[-1]
        return json.loads(self.spark.read.text(f"{self.root}/_commits/{batch:012d}.json", wholetext=True).first()[0])

    def has(self, batch: int) -> bool:
        fs, path, _ = _fs(self.spark, f"{self.root}/_commits/{batch:012d}.json")
        return fs.exists(path)

    def table(self, name: str, schema: str | T.StructType, buckets: Sequence[int] | None = None) -> DataFrame:
        """A keyed table, or only some of its buckets, as the last batch left it."""
        known = self.manifest()["keyed"].get(name, {"paths": {}})["paths"]
        paths = [p for b, p in known.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def events(self, name: str, schema: str | T.StructType) -> DataFrame:
        """All rows that committed batches appended to an event table."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], schema)
        lists = self.spark.read.text(f"{self.root}/_commits/*.json", wholetext=True).select(F.from_json("value", "events map<string,array<string>>")["events"][name].alias("p"))
        paths = [r.p for r in lists.select(F.explode("p").alias("p")).orderBy("p").collect()]  # one short line per batch
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def batch(self, number: int) -> Batch:
        return Batch(self, number)


class Batch:
    """What one batch writes; nothing of it is visible before ``commit``."""

    def __init__(self, store: Store, number: int) -> None:
        self.store, self.number, self.tag = store, number, f"b{number:012d}-{uuid.uuid4().hex[:12]}"
        self.before = store.manifest()
        self.keyed = {k: {"buckets": v["buckets"], "paths": dict(v["paths"])} for k, v in self.before["keyed"].items()}
        self.events: dict[str, list[str]] = {}
        self.replaced: list[str] = []
        self.touched: dict[str, list[int]] = {}

    def _touched(self, name: str, key: Sequence[str], rows: DataFrame) -> tuple[dict, Column, list[int]]:
        table = self.keyed.setdefault(name, {"buckets": self.store.buckets, "paths": {}})
        bucket = F.pmod(F.xxhash64(*key), F.lit(table["buckets"])).cast("int")
        return table, bucket, sorted(r[0] for r in rows.select(bucket).distinct().collect())  # at most one row per bucket

    def current(self, name: str, schema: str | T.StructType, key: Sequence[str], rows: DataFrame) -> DataFrame:
        """The rows of a keyed table in the buckets of the keys of ``rows``, as the last batch left them."""
        return self.store.table(name, schema, self._touched(name, key, rows)[2])

    def merge(self, name: str, schema: str | T.StructType, key: Sequence[str], new: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``step(current rows, new rows)`` over the buckets that ``new`` touches; gives back what it returned, as written.

        ``step`` returns one row per key with at least the columns of ``schema``; flags such as ``inserted`` are for the caller and not read again.  ``new`` is
        read twice, so hand over a written table."""
        table, bucket, self.touched[name] = self._touched(name, key, new)
        now = step(self.store.table(name, schema, self.touched[name]), new).withColumn(BUCKET, bucket)
        path = f"{self.store.root}/{name}/{self.tag}"
        now.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
        for b in self.touched[name]:
            if str(b) in table["paths"]:
                self.replaced.append(table["paths"][str(b)])
            table["paths"][str(b)] = f"{path}/{BUCKET}={b}"
        return self.store.spark.read.schema(now.drop(BUCKET).schema).parquet(path)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.store.root}/{name}/{self.tag}"
        rows.write.parquet(path)
        self.events.setdefault(name, []).append(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def commit(self) -> bool:
        """Make the batch visible; false if another attempt of it came first, whose result then stands."""
        fs, final, hadoop = _fs(self.store.spark, f"{self.store.root}/_commits/{self.number:012d}.json")
        body = json.dumps({"batch": self.number, "keyed": self.keyed, "events": self.events, "replaced": self.replaced})
        draft = hadoop.Path(f"{self.store.root}/_drafts/{self.tag}.json")
        out = fs.create(draft, True)
        out.write(bytearray(body.encode()))
        out.close()
        fs.mkdirs(final.getParent())
        done = not fs.exists(final) and fs.rename(draft, final)
        if done:
            for path in self.before["replaced"]:  # what the batch before replaced: nobody starts to read it any more
                fs.delete(hadoop.Path(path), True)
        return done
