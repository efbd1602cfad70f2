"""Event routing, refused writes, scope checks with refreshed rules, queue metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.jobs import queue_metrics
from palisade.operators.scope import drop_rule_table, scope_rules, with_decision
from palisade.sources.events import dead_letter_rows, validate_events
from palisade.streaming.base import append_batch, run_batches


def route_stream(lines: DataFrame, allowed: Iterable[str] | None, *, events: str, errors: str, checkpoint: str, trigger=None):
    """Validate a stream of event JSON and write good events and error rows to two tables, with the time of ingestion."""
    names = None if allowed is None else list(allowed)

    def process(batch: DataFrame, batch_id: int) -> None:
        checked = validate_events(batch, names).withColumn("ingested", F.current_timestamp())
        append_batch(checked.filter(F.col("error_type").isNull()), events, batch_id)
        append_batch(checked.filter(F.col("error_type").isNotNull()), errors, batch_id)

    return run_batches(lines, process, checkpoint, trigger=trigger)


def dead_letter_stream(rejected: DataFrame) -> DataFrame:
    """Stateless: refused writes become error rows."""
    return dead_letter_rows(rejected)


class RulesUnavailable(RuntimeError):
    """Scope rules could not be read or contain an invalid rule: nothing may be evaluated."""


def load_rules(read: Callable[[], DataFrame]) -> DataFrame:
    """Read and check rules; fails closed."""
    try:
        rules = scope_rules(read())
        bad = rules.filter(F.col("error").isNotNull()).limit(1).collect()
    except Exception as exc:
        raise RulesUnavailable(f"scope rules cannot be read: {exc}") from exc
    if bad:
        raise RulesUnavailable(f"invalid scope rule {bad[0]['rule_id']}: {bad[0]['error']}")
    return rules


class RuleVersions:
    """The rules of a running stream: read for every micro-batch, but checked, normalised and keyed only when their content has changed.

    The version before is deleted then; batches follow one another, so nothing reads it any more."""

    def __init__(self, read: Callable[[], DataFrame]) -> None:
        self.read, self.mark, self.rules = read, None, None

    def current(self) -> DataFrame:
        """The rules as they are now; fails closed."""
        try:
            raw = self.read()
            row = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in raw.columns]
            total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)"))
            mark = (tuple(raw.columns), *raw.agg(F.count(F.lit(1)), total(0), total(1)).first())
        except Exception as exc:
            raise RulesUnavailable(f"scope rules cannot be read: {exc}") from exc
        if mark != self.mark:
            old, self.rules = self.rules, load_rules(lambda: raw)
            self.mark = mark
            if old is not None:
                drop_rule_table(old)
        return self.rules


def scoped_stream(stream: DataFrame, read_rules: Callable[[], DataFrame], *, output: str, checkpoint: str, trigger=None):
    """Decide a stream of (target, program_id, ...); the rules are read again for every micro-batch, so an edited rule
    counts from the next batch on, and a batch fails when they are unusable."""
    versions = RuleVersions(read_rules)

    def process(batch: DataFrame, batch_id: int) -> None:
        append_batch(with_decision(batch, versions.current(), "target", "program_id"), output, batch_id)

    return run_batches(stream, process, checkpoint, trigger=trigger)


def queue_metric_stream(ticks: DataFrame, read_jobs: Callable[[], DataFrame], read_workers: Callable[[], DataFrame], *, output: str, checkpoint: str, trigger=None):
    """Queue-depth rows per tick; ``ticks`` is any stream with a time stamp column ``ts``."""

    def process(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("ts").alias("t")).first()["t"]
        if now is not None:
            append_batch(queue_metrics(read_jobs(), read_workers(), F.lit(now)), output, batch_id)

    return run_batches(ticks, process, checkpoint, trigger=trigger)
