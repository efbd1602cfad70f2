"""Notifications as a data flow: events -> notifications -> policy matches -> deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.common import literal_table, lookup, opaque, sha256, shorten
from palisade.operators.skew import first_per_key, with_row_number

_RANK = {s: i for i, s in enumerate(K.SEVERITIES)}


def to_notifications(events: DataFrame) -> DataFrame:
    """Notifiable events as notifications: type, severity, title, detail and the key of the underlying fact.

    events: (event_id, ts, type, program_id, program_name, asset_id, asset_value, current, previous, tool, job_id,
    error_message, retry_count).  List values arrive as comma-separated text."""
    table = literal_table(
        events.sparkSession, [(k, t, s, K.NOTIFICATION_TITLES[t]) for k, (t, s) in sorted(K.NOTIFIABLE.items())],
        "type string, notification_type string, severity string, __title string",
    )
    df = events.join(F.broadcast(table), "type")
    failure = F.col("type").isin("SCAN_FAILURE", "DLQ_EVENT")
    value, cur, prev = F.col("asset_value"), F.col("current"), F.col("previous")
    kind = F.col("type")
    given = lambda c: c.isNotNull() & (c != "")
    text = lambda c: F.coalesce(c, F.lit("None"))
    unknown = lambda c: F.coalesce(F.when(c != "", c), F.lit("?"))
    title = F.when(
        failure, F.concat("__title", F.lit(": "), F.coalesce("tool", F.lit("?")), F.lit(" on "), unknown(value))
    ).otherwise(F.concat("__title", F.lit(": "), F.coalesce(F.when(value != "", value), shorten(text(cur), 120))))
    detail = (
        F.when(failure, shorten(F.coalesce("error_message", F.lit("")), 300))
        .when(given(prev), F.concat(kind, F.lit(": "), shorten(prev, 300), F.lit(" -> "), shorten(text(cur), 300)))
        .when(given(cur), F.concat(kind, F.lit(": "), shorten(cur, 300)))
        .otherwise(F.concat(kind, F.lit(" detected on "), F.coalesce(F.when(value != "", value), F.lit("asset")), F.lit(" (field-level changes in bb-changes-*)")))
    )
    fact = F.when(
        failure, F.concat_ws("|", kind, text(F.col("job_id").cast("string")), text(F.col("retry_count").cast("string")))
    ).otherwise(F.concat_ws("|", kind, F.coalesce(F.col("asset_id").cast("string"), text(value)), text(cur)))
    return opaque(df, __t=title, __d=detail, __f=sha256(fact)).select(
        "event_id", "ts", F.col("notification_type").alias("type"), "severity", F.col("type").alias("event_type"), "program_id", "program_name",
        "asset_value", F.col("__t").alias("title"), F.col("__d").alias("detail"), F.col("__f").alias("fact_key"),
    )


def severity_rank(c: Column) -> Column:
    return lookup(_RANK, c, 0)


def match_policies(notes: DataFrame, policies: DataFrame, channels: DataFrame) -> DataFrame:
    """Enabled policies of enabled channels that want a notification: program NULL or equal, type listed or '*',
    severity at least the minimum.

    Policies are opened up to one row per (type, program key); '*' becomes every type, NULL program a wildcard key, so the
    match is an equi-join.  policies: (policy_id, channel_id, enabled, program_id, event_types, min_severity)."""
    types = sorted({t for t, _ in K.NOTIFIABLE.values()} | {"TEST"})
    every = F.array(*[F.lit(t) for t in types])
    wanted = F.when(F.array_contains("event_types", "*"), F.array_union(every, F.col("event_types"))).otherwise(F.col("event_types"))
    on = channels.filter("enabled").select("channel_id")
    open_ = policies.filter("enabled").join(on, "channel_id", "left_semi").select(
        "policy_id", "channel_id", F.coalesce(F.col("program_id").cast("string"), F.lit("*")).alias("__p"), F.explode(F.array_distinct(wanted)).alias("type"),
        F.coalesce(severity_rank(F.col("min_severity")), F.lit(0)).alias("__min"),
    )
    from palisade.operators.skew import lookup_join

    # a policy row carries either '*' or a program, so the two probes of a notification never meet the same row twice
    probes = notes.withColumn(
        "__p", F.explode(F.array_distinct(F.array(F.lit("*"), F.coalesce(F.col("program_id").cast("string"), F.lit("*")))))
    )
    hits = lookup_join(probes, open_, ["type", "__p"], "inner", fanout=len(types))
    return hits.filter(severity_rank(F.col("severity")) >= F.col("__min")).drop("__p", "__min")


def dedup_key() -> Column:
    return sha256(F.concat_ws("|", F.col("policy_id").cast("string"), F.col("type"), F.col("fact_key")))


def dedupe(matched: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """First notification of each (policy, type, fact); facts delivered before are dropped."""
    keyed = matched.withColumn("dedup_key", dedup_key())
    first = first_per_key(keyed, ["dedup_key"], [F.col("ts"), F.col("event_id")])
    return first if delivered is None else first.join(delivered.select("dedup_key"), "dedup_key", "left_anti")


def rate_limit(notes: DataFrame, per_minute: int = 20) -> DataFrame:
    """Per channel and minute the first ``per_minute`` are sent, the rest deferred.  Numbered second by second, so one
    busy channel is spread."""
    minute = notes.withColumn("minute", F.date_trunc("minute", F.col("ts")))
    order = [F.asc("ts"), F.asc("event_id"), F.asc("dedup_key")]
    ranked = with_row_number(minute, ["channel_id", "minute"], order, [(F.date_trunc("second", F.col("ts")), True)], "position")
    sent = F.col("position") <= per_minute
    return ranked.withColumns(
        {"outcome": F.when(sent, "sent").otherwise("deferred"), "retry_in_seconds": F.when(~sent, K.DEFER_SECONDS)}
    )


def delivery_outcome(attempts: DataFrame) -> DataFrame:
    """What a delivery attempt leads to.  attempts: (delivery_id, attempts - counted with this one, error:
    NULL | 'config' | 'transient')."""
    most = len(K.DELIVERY_BACKOFF_SECONDS) + 1
    error = F.col("error")
    outcome = F.when(error.isNull(), "sent").when(error == "config", "failed").when(F.col("attempts") >= most, "failed").otherwise("retry")
    backoff = F.get(F.array(*map(F.lit, K.DELIVERY_BACKOFF_SECONDS)), F.col("attempts") - 1)
    return attempts.withColumns({"outcome": outcome, "retry_in_seconds": F.when(outcome == "retry", backoff)})


def due_retries(retries: DataFrame, t: Column, *, limit: int) -> DataFrame:
    return retries.filter(F.col("due_at") <= t).orderBy("due_at", "delivery_id").limit(limit)


def render(notes: DataFrame) -> DataFrame:
    """Add ``text``: '[program] SEVERITY title', newline, detail."""
    where = F.when(F.col("program_name") != "", F.concat(F.lit("["), "program_name", F.lit("] "))).otherwise(F.lit(""))
    return notes.withColumn("text", F.concat(F.coalesce(where, F.lit("")), F.upper("severity"), F.lit(" "), "title", F.lit("\n"), "detail"))
