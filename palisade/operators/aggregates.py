"""Counters of the platform tables.  All are hash aggregations that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.common import epoch_seconds, literal_table


def _metric(df: DataFrame, name: str, where: Column | None = None, by: str | None = None) -> DataFrame:
    df = df if where is None else df.filter(where)
    key = (F.lit(None).cast("string") if by is None else F.col(by).cast("string")).alias("key")
    grouped = df.groupBy(key) if by is not None else df.groupBy()
    out = grouped.agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.lit(name).alias("metric"), key if by is None else F.col("key"), "n")


def stats(programs: DataFrame, scope: DataFrame, assets: DataFrame, edges: DataFrame, jobs: DataFrame, audit: DataFrame) -> DataFrame:
    """(metric, key, n): programs, scope entries, assets by type, edges, jobs by status, scope blocks."""
    alive = F.col("deleted_at").isNull()
    parts = [
        _metric(programs, "programs.total", alive), _metric(programs, "programs.active", alive & F.col("active")),
        _metric(scope, "scope_entries", F.col("active")), _metric(assets, "assets", by="asset_type"),
        _metric(edges, "relationships"), _metric(jobs, "jobs", by="status"),
        _metric(audit, "scope_blocked", F.col("action") == "SCOPE_BLOCKED"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("scanner", "status").agg(F.count(F.lit(1)).alias("jobs"))


def job_gauges(jobs: DataFrame) -> DataFrame:
    """Running and failed jobs per scanner."""
    return jobs.groupBy("scanner").agg(
        F.count_if(F.col("status") == "RUNNING").alias("running"), F.count_if(F.col("status") == "FAILED").alias("failed")
    )


def avg_duration(jobs: DataFrame) -> DataFrame:
    """Mean seconds of successful jobs per scanner."""
    seconds = epoch_seconds(F.col("finished_at")) - epoch_seconds(F.col("started_at"))
    return jobs.filter(F.col("status") == "SUCCESS").groupBy("scanner").agg(F.avg(seconds).alias("avg_seconds"))


def asset_counts(assets: DataFrame) -> DataFrame:
    """Assets by type, with how many were scanned at least once."""
    return assets.groupBy("asset_type").agg(
        F.count(F.lit(1)).alias("assets"), F.count("last_scanned").alias("scanned")
    )


def vuln_counts(correlations: DataFrame, kev: DataFrame) -> DataFrame:
    """(metric, key, n): correlations by status, distinct correlated CVEs in the live catalogue."""
    live = kev.filter(F.col("removed_at").isNull()).select("cve_id")
    matches = correlations.join(live, "cve_id", "left_semi").agg(F.countDistinct("cve_id").alias("n"))
    return _metric(correlations, "cve_matches", by="status").unionByName(
        matches.select(F.lit("kev_matches").alias("metric"), F.lit(None).cast("string").alias("key"), "n")
    )


def delivery_counts(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("status").agg(F.count(F.lit(1)).alias("deliveries"))


def oldest_queued(jobs: DataFrame, now: Column) -> DataFrame:
    """Age in seconds of the oldest queued job per scanner, never negative."""
    queued = jobs.filter((F.col("status") == "QUEUED") & F.col("queued_at").isNotNull())
    age = epoch_seconds(now) - epoch_seconds(F.min("queued_at"))
    return queued.groupBy("scanner").agg(F.greatest(F.lit(0.0), age).alias("oldest_seconds"))


def scanner_queues(jobs: DataFrame) -> DataFrame:
    """Constant map scanner -> queue as a table."""
    return literal_table(jobs.sparkSession, sorted((s, q) for s, (q, _) in K.SCANNERS.items()), "scanner string, queue string")


def pool_report(jobs: DataFrame, workers: DataFrame, now: Column) -> DataFrame:
    """Per queue: waiting jobs, high-priority ones, live and busy workers, age of the oldest waiting job.

    workers: (worker_id, queue, current_job)."""
    queues = scanner_queues(jobs)
    waiting = jobs.filter(F.col("status") == "QUEUED").join(F.broadcast(queues), "scanner")
    age = epoch_seconds(now) - epoch_seconds(F.min("queued_at"))
    depth = waiting.groupBy("queue").agg(
        F.count(F.lit(1)).alias("pending"), F.count_if(F.col("priority") >= K.HIGH_PRIORITY).alias("high_priority"),
        F.greatest(F.lit(0.0), age).alias("oldest_seconds"),
    )
    pool = workers.groupBy("queue").agg(F.count(F.lit(1)).alias("workers"), F.count("current_job").alias("busy_workers"))
    out = queues.select("queue").distinct().join(depth, "queue", "left").join(pool, "queue", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("queue", zero("pending"), zero("high_priority"), zero("workers"), zero("busy_workers"), "oldest_seconds")


def scan_status(jobs: DataFrame) -> DataFrame:
    """COMPLETED once no job of the scan is open."""
    still_open = F.count_if(~F.col("status").isin(*K.TERMINAL_JOB_STATUSES))
    return jobs.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("jobs"), still_open.alias("open_jobs"), F.when(still_open == 0, "COMPLETED").otherwise("RUNNING").alias("scan_status")
    )


def plan_summary(plan: DataFrame) -> DataFrame:
    key = F.when(F.col("duplicate"), "DUPLICATE").otherwise(F.col("status")).alias("outcome")
    return plan.groupBy(key).agg(F.count(F.lit(1)).alias("jobs"))


def run_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per observation batch.  rows: (keys, malformed boolean, allowed boolean, severity)."""
    good = ~F.col("malformed")
    counts = [
        F.count_if(good).alias("records"), F.count_if(good & F.col("allowed")).alias("accepted"),
        F.count_if(good & ~F.col("allowed")).alias("scope_blocked"), F.count_if(F.col("malformed")).alias("malformed"),
    ]
    for s in ("critical", "high", "medium", "low", "info", "unknown"):
        counts.append(F.count_if(good & F.col("allowed") & (F.col("severity") == s)).alias(f"severity_{s}"))
    return rows.groupBy(*keys).agg(*counts)


def open_ports(obs: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Sorted distinct ports per host (at most 65,536 numbers)."""
    valid = F.col("port").between(0, 65535)
    return obs.filter(valid).groupBy(*keys).agg(F.array_sort(F.collect_set("port")).alias("ports"))


def url_inventory(urls: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct URLs of a crawl with their first record; ``urls``: (keys, url_hash, seq, ...)."""
    from palisade.operators.skew import first_per_key

    return first_per_key(urls, [*keys, "url_hash"], [F.col("seq")])


def endpoint_inventory(urls: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct endpoints with the text of the first URL that showed them and their number of URLs."""
    return urls.groupBy(*keys, "endpoint_hash").agg(
        F.min_by("endpoint", "seq").alias("endpoint"), F.countDistinct("url_hash").alias("urls")
    )


def best_technology(fingerprints: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, name): versioned first, then higher confidence, then the first seen.

    fingerprints: (keys, name, version, confidence, source, seq)."""
    from palisade.operators.skew import first_per_key

    order = [F.when(F.col("version").isNull(), 1).otherwise(0), -F.col("confidence"), F.col("seq")]
    return first_per_key(fingerprints, [*keys, "name"], order)
