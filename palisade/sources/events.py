"""The event table: reading, validation, routing, writing, current-state view, retention, snapshots."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import constants as K
from palisade import schemas as S
from palisade.functions.common import literal_table, opaque, strip
from palisade.operators.skew import first_per_key, last_per_key, tasks_by_input


def validate_events(lines: DataFrame, allowed: Iterable[str] | None = None, col: str = "value") -> DataFrame:
    """Parse event JSON and decide where each event goes.

    Adds ``ts``, ``index``, ``doc_id``, ``kind``, ``category``, ``type``, ``error_type``, ``error_message``,
    ``payload`` and ``ym`` (month of the event).  Rows with an ``error_type`` belong to the error index: MALFORMED_EVENT
    (broken JSON or time stamp), MISSING_REQUIRED_FIELD, INDEX_NOT_ALLOWED."""
    names = sorted({i for group in K.STREAM_INDICES.values() for i in group} if allowed is None else set(allowed))
    text = strip(F.col(col))
    parsed = F.from_json(text, S.EVENT + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    df = opaque(lines, __t=text, __e=parsed)
    e = F.col("__e")
    ts = e["@timestamp"].try_cast("timestamp")
    broken = ~F.coalesce(F.startswith(F.col("__t"), F.lit("{")), F.lit(False)) | e.isNull() | e["__bad"].isNotNull()
    broken = broken | (e["@timestamp"].isNotNull() & ts.isNull())
    missing = e["bb"]["index"].isNull() | e["event"]["type"].isNull() | e["event"]["kind"].isNull()
    error = (
        F.when(broken, "MALFORMED_EVENT").when(missing, "MISSING_REQUIRED_FIELD")
        .when(~e["bb"]["index"].isin(names), "INDEX_NOT_ALLOWED")
    )
    df = opaque(df, error_type=error, __ts=ts)
    keep = [c for c in lines.columns if c != col]
    ok = F.col("error_type").isNull()
    return df.select(
        *keep, F.col("__ts").alias("ts"), F.when(ok, e["bb"]["index"]).otherwise("bb-errors").alias("index"),
        F.when(ok, e["bb"]["doc_id"]).alias("doc_id"), e["event"]["kind"].alias("kind"), e["event"]["category"].alias("category"),
        e["event"]["type"].alias("type"), "error_type",
        F.when(F.col("error_type") == "MALFORMED_EVENT", F.col("__t")).alias("error_message"), F.col("__t").alias("payload"),
        F.date_format("__ts", "yyyy.MM").alias("ym"),
    )


def dead_letter_rows(rejected: DataFrame, payload: str = "payload", reason: str = "reason", pipeline: str = "pipeline") -> DataFrame:
    """Error rows for writes the store refused; the payload is kept, cut."""
    keep = [c for c in rejected.columns if c not in (payload, reason, pipeline)]
    return rejected.select(
        *keep, F.lit("bb-errors").alias("index"), F.lit("pipeline_error").alias("kind"), F.lit("DLQ_EVENT").alias("type"),
        F.lit("ELASTICSEARCH_REJECTED").alias("error_type"), F.col(reason).alias("error_message"),
        F.col(pipeline).alias("pipeline"), F.col(payload).alias("original"),
    )


def drop_empty(fields: Mapping[str, Column]) -> Column | None:
    """Struct of the given fields, NULL when all of them are."""
    if not fields:
        return None
    struct = F.struct(*[c.alias(n) for n, c in fields.items()])
    some = F.greatest(F.lit(False), *[c.isNotNull() for c in fields.values()])
    return F.when(some, struct)


def build_event(
    df: DataFrame, *, index: Column | str, kind: Column | str, category: Column | str, type_: Column | str, ts: Column,
    context: Mapping[str, Mapping[str, Column]] | None = None, body: Mapping[str, Mapping[str, Column] | Column] | None = None,
    doc_id: Column | None = None, keep: Iterable[str] = (),
) -> DataFrame:
    """Event rows (ts, index, ym, doc_id, kind, category, type, payload).

    ``context`` holds provenance sections (program, scope, asset, scan, source), ``body`` the rest; a section in both is
    merged field by field, the body winning.  NULL fields and empty sections do not appear in the payload."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    sections: dict[str, Mapping[str, Column] | Column] = {k: dict(v) for k, v in (context or {}).items()}
    for name, value in (body or {}).items():
        old = sections.get(name)
        sections[name] = {**old, **value} if isinstance(old, dict) and isinstance(value, Mapping) else value
    when = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    head = [
        when.alias("@timestamp"),
        F.struct(lit(kind).alias("kind"), lit(category).alias("category"), lit(type_).alias("type"), lit(type_).alias("action")).alias("event"),
        F.struct(
            lit(index).alias("index"), (F.lit(None).cast("string") if doc_id is None else doc_id).alias("doc_id"),
            F.lit(K.SCHEMA_VERSION).alias("schema_version"),
        ).alias("bb"),
    ]
    tail = []
    for name, value in sections.items():
        col = drop_empty(value) if isinstance(value, Mapping) else value
        if col is not None:
            tail.append(col.alias(name))
    return df.select(
        *keep, ts.alias("ts"), lit(index).alias("index"), F.date_format(ts, "yyyy.MM").alias("ym"),
        (F.lit(None).cast("string") if doc_id is None else doc_id).alias("doc_id"), lit(kind).alias("kind"),
        lit(category).alias("category"), lit(type_).alias("type"), F.to_json(F.struct(*head, *tail)).alias("payload"),
    )


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the table partitioned by index and month.

    A writer sorts the rows it holds, whole payloads included.  Of a large input each gets a range by index, month and time, as many as the input needs; a
    value that holds most of the rows is cut by time.  Of others the rebalance lets the adaptive planner cut such a value into several files."""
    tasks = tasks_by_input(events, share=2)
    if tasks is None:
        laid = events.hint("rebalance", "index", "ym")
    else:
        laid = events.repartitionByRange(tasks, "index", "ym", "ts", F.xxhash64("payload"))
    laid.write.mode(mode).partitionBy("index", "ym").parquet(path)


def read_events(spark: SparkSession, path: str, pattern: str = "bb-*") -> DataFrame:
    """Events of the indices matching a pattern such as ``bb-http`` or ``bb-*``; the match prunes partitions."""
    return matching(spark.read.parquet(path), pattern)


def matching(events: DataFrame, pattern: str) -> DataFrame:
    pattern = "bb-*" if pattern == "bb-all" else pattern
    if "*" not in pattern:
        return events.filter(F.col("index") == pattern)
    if pattern.count("*") == 1 and pattern.endswith("*"):
        return events.filter(F.startswith(F.col("index"), F.lit(pattern[:-1])))
    return events.filter(F.col("index").rlike(fnmatch.translate(pattern).replace("(?s:", "(?:").replace("\\z", "$").replace("\\Z", "$")))


def latest_docs(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Upsert view: documents with an id keep their last write within index and month, others are all kept."""
    with_id = events.filter(F.col("doc_id").isNotNull())
    newest = last_per_key(with_id, ["index", "ym", "doc_id"], [F.col("ts"), F.col(seq)])
    return newest.unionByName(events.filter(F.col("doc_id").isNull()))


def apply_retention(events: DataFrame, now: Column, days: Mapping[str, int] = K.RETENTION_DAYS) -> DataFrame:
    """Rows still kept.  A month is dropped as a whole once its last day is older than the index's limit."""
    policy = literal_table(events.sparkSession, sorted(days.items()), "index string, __days int")
    month_end = F.last_day(F.to_date(F.concat(F.col("ym"), F.lit(".01")), "yyyy.MM.dd"))
    kept = events.join(F.broadcast(policy), "index", "left").filter(
        F.col("__days").isNull() | (F.datediff(now.cast("date"), month_end) <= F.col("__days"))
    )
    return kept.drop("__days")


# --- full-replace tables as snapshot directories --------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, hadoop


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first; a version counts once its write has finished."""
    fs, root, hadoop = _fs(spark, path)
    if not fs.exists(root):
        return []
    out = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
            out.append(int(name[1:]))
    return sorted(out)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    versions = snapshot_versions(spark, path)
    return spark.read.parquet(f"{path}/v{versions[-1]:010d}") if versions else None


def write_snapshot(df: DataFrame, path: str, version: int | None = None) -> int:
    """Write the next version beside the current one.  Readers see it only when its success marker exists, so they
    never meet a half-written or empty table; a retried write of the same version replaces its own leftovers."""
    if version is None:
        version = (snapshot_versions(df.sparkSession, path) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{path}/v{version:010d}")
    return version


class TruncatedLoad(ValueError):
    """The new content is implausibly small; the current table is kept."""


def replacement(new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """New content of a full-replace table: one row per key, ties by ``order``."""
    return first_per_key(new, key, order)


def replace_table(new: DataFrame, path: str, key: list[str], order: list[Column], min_rows: int = K.MIN_ASN_ROWS) -> int:
    """Load new content as the table's next version; refused when fewer than ``min_rows`` rows arrived."""
    rows = new.count()
    if rows < min_rows:
        raise TruncatedLoad(f"only {rows} rows; keeping the current data")
    return write_snapshot(replacement(new, key, order), path)
