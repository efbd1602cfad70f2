"""Top-N, histograms and fair-share ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade import constants as K
from palisade.operators.skew import with_row_number


def _values(df: DataFrame, field: str) -> Column:
    """A field as one value per row; array fields are exploded, each value once per document."""
    is_array = df.select(field).schema[0].dataType.typeName() == "array"
    return F.explode(F.array_distinct(F.col(field))) if is_array else F.col(field)


def terms(df: DataFrame, field: str, n: int = 10) -> DataFrame:
    """(key, value): the n most frequent values; ties by key; NULL is not a value."""
    flat = df.select(_values(df, field).alias("key")).filter(F.col("key").isNotNull())
    counted = flat.groupBy(F.col("key").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return counted.orderBy(F.desc("value"), F.asc("key")).limit(n)


def terms_table(
    df: DataFrame, fields: Sequence[str], n: int = 20, metric: Column | None = None
) -> DataFrame:
    """Nested top-n: the n best values of the first field, inside each the n best of the second, and so on.

    (k1, .., km, value); ``metric`` is an aggregate over the documents of a bucket, by default their number; each level is
    ordered by the metric of its own buckets.  Documents lacking a field do not appear below that level."""
    m = len(fields)
    keys = [f"k{i + 1}" for i in range(m)]
    staged = [f"__k{i + 1}" for i in range(m)]
    measure = F.count(F.lit(1)) if metric is None else metric
    keep = None
    for level in range(1, m + 1):
        # documents that have the fields of this level; deeper explodes must not multiply the counts
        at = df
        for i, f in enumerate(fields[:level]):
            at = at.withColumn(f"__k{i + 1}", _values(at, f)).withColumn(f"__k{i + 1}", F.col(f"__k{i + 1}").cast("string"))
        at = at.na.drop(subset=staged[:level])
        agg = at.groupBy(*[F.col(s).alias(k) for s, k in zip(staged[:level], keys[:level])]).agg(measure.alias("value"))
        if keep is not None:
            agg = agg.join(keep.drop("value"), keys[: level - 1], "left_semi")
        if level == 1:
            keep = agg.orderBy(F.desc("value"), F.asc("k1")).limit(n)
        else:
            w = Window.partitionBy(*keys[: level - 1]).orderBy(F.desc("value"), F.asc(keys[level - 1]))
            keep = agg.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
    return keep


def timeseries(df: DataFrame, ts: str, interval: str, split: str | None = None, split_size: int = 8) -> DataFrame:
    """(bucket, key, value): documents per time bucket, empty buckets left out; with ``split`` one series for each of the
    most frequent values."""
    bucket = F.date_trunc(interval, F.col(ts)).alias("bucket")
    if split is None:
        out = df.filter(F.col(ts).isNotNull()).groupBy(bucket).agg(F.count(F.lit(1)).alias("value"))
        return out.select("bucket", F.lit(None).cast("string").alias("key"), "value")
    flat = df.filter(F.col(ts).isNotNull()).select(bucket, _values(df, split).alias("key")).filter(F.col("key").isNotNull())
    counted = flat.groupBy("bucket", F.col("key").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    top = counted.groupBy("key").agg(F.sum("value").alias("__n")).orderBy(F.desc("__n"), F.asc("key")).limit(split_size)
    return counted.join(F.broadcast(top.select("key")), "key", "left_semi").select("bucket", "key", "value")


def distinct_count(df: DataFrame, field: str, exact: bool = True) -> DataFrame:
    """Number of distinct values; the approximate form uses a HyperLogLog++ sketch."""
    fn = F.countDistinct if exact else F.approx_count_distinct
    return df.agg(fn(F.col(field)).alias("value"))


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key.  For n up to 1000 the planner cuts each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


# --- fair share over the job table ------------------------------------------------------------------------


def _pending(jobs: DataFrame, now: Column | None) -> DataFrame:
    due = F.col("status") == "PENDING"
    if now is not None and "next_attempt_at" in jobs.columns:
        due = due & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    return jobs.filter(due)


def fair_share_rank(jobs: DataFrame, limit: int | None = None, now: Column | None = None) -> DataFrame:
    """Pending jobs numbered within (program, scanner) by priority, then age; with ``limit`` the first jobs of the
    round-robin order over all pairs."""
    order = [F.desc("priority"), F.asc("created_at"), F.asc("job_id")]
    pending = _pending(jobs, now)
    if limit is not None and limit <= 1000:
        # nothing beyond position ``limit`` of a pair can be among the first ``limit`` rows overall
        w = Window.partitionBy("program_id", "scanner").orderBy(*order)
        ranked = pending.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    else:
        lead = [(F.col("priority"), False), (F.date_trunc("day", F.col("created_at")), True)]
        ranked = with_row_number(pending, ["program_id", "scanner"], order, lead)
    ranked = ranked.select(*jobs.columns, F.col("rank").cast("long").alias("rank"))
    if limit is None:
        return ranked
    return ranked.orderBy("rank", F.desc("priority"), "created_at", "job_id").limit(limit)


def fair_share_admit(jobs: DataFrame, cap: int = K.QUEUE_CAP, now: Column | None = None) -> DataFrame:
    """Pending jobs that may be queued now.

    A pair (program, scanner) may hold at most ``cap`` waiting jobs; jobs of high priority ignore the cap but count.
    Closed form of the dispatch loop: everything of high priority, then the first ``cap - queued - high`` others."""
    pair = ["program_id", "scanner"]
    pending = _pending(jobs, now)
    high = pending.filter(F.col("priority") >= K.HIGH_PRIORITY)
    if cap <= 0:
        return pending
    used = (
        jobs.filter(F.col("status") == "QUEUED").groupBy(*pair).agg(F.count(F.lit(1)).alias("__n"))
        .unionByName(high.groupBy(*pair).agg(F.count(F.lit(1)).alias("__n")))
        .groupBy(*pair).agg(F.sum("__n").alias("__used"))
    )
    rest = pending.filter(F.col("priority") < K.HIGH_PRIORITY)
    first = cap_per_group_ranked(rest, pair, [F.desc("priority"), F.asc("created_at"), F.asc("job_id")], cap)
    fits = first.join(used, pair, "left").filter(F.col("__r") + F.coalesce("__used", F.lit(0)) <= cap)
    return high.unionByName(fits.select(*jobs.columns))


def cap_per_group_ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)


def last_import(runs: DataFrame) -> DataFrame:
    """Latest import run per source.  runs: (source, imported_at, run_id, ...)."""
    from palisade.operators.skew import last_per_key

    return last_per_key(runs, ["source"], [F.col("imported_at"), F.col("run_id")])
