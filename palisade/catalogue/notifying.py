"""Notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue.registry import register
from palisade.catalogue.standins import standin
from palisade.operators import notify

_NOTE = """
    SELECT event_id, ts, CASE type WHEN 'DLQ_EVENT' THEN 'DLQ_EVENT' WHEN 'NEW_SUBDOMAIN' THEN 'NEW_SUBDOMAIN' WHEN 'KEV_ADDED' THEN 'NEW_KEV' ELSE 'TLS_CHANGED' END AS ntype,
           CASE type WHEN 'DLQ_EVENT' THEN 'medium' WHEN 'NEW_SUBDOMAIN' THEN 'info' WHEN 'KEV_ADDED' THEN 'critical' ELSE 'low' END AS severity, program_id, program_name,
           CASE type WHEN 'DLQ_EVENT' THEN 'Job dead-lettered: httpx on ' || asset_value WHEN 'NEW_SUBDOMAIN' THEN 'New subdomain: ' || asset_value
               WHEN 'KEV_ADDED' THEN 'Known exploited vulnerability (KEV): ' || asset_value ELSE 'TLS changed: ' || asset_value END AS title,
           CASE WHEN type = 'DLQ_EVENT' THEN error_message WHEN previous IS NOT NULL THEN type || ': ' || previous || ' -> ' || COALESCE(current, 'None') WHEN current IS NOT NULL THEN type || ': ' || current
               ELSE type || ' detected on ' || asset_value || ' (field-level changes in bb-changes-*)' END AS detail,
           SHA(CASE WHEN type = 'DLQ_EVENT' THEN type || '|' || job_id || '|' || CAST(retry_count AS VARCHAR) ELSE type || '|' || asset_id || '|' || COALESCE(current, 'None') END) AS fact_key
    FROM notes WHERE type <> 'HTTP_STATUS_CHANGED'"""
_RANK = "CASE {} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END"
_MATCHED = f"""
    SELECT n.*, p.policy_id, p.channel_id, SHA(p.policy_id || '|' || n.ntype || '|' || n.fact_key) AS dedup_key FROM note n JOIN policies p ON p.enabled AND (p.program_id IS NULL OR p.program_id = n.program_id)
        AND (p.event_types = '*' OR list_contains(string_split(p.event_types, ','), n.ntype)) AND {_RANK.format('n.severity')} >= {_RANK.format("COALESCE(p.min_severity, 'info')")} JOIN channels c ON c.channel_id = p.channel_id AND c.enabled"""
_FIRST = "SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY ts, event_id) = 1"
SETS = {"note": _NOTE, "matched": _MATCHED, "first_notes": _FIRST}


def _notes(spark, d):
    return notify.to_notifications(standin(spark, d, "notes"))


def policies(spark, d):
    return standin(spark, d, "policies").withColumn("event_types", F.split("event_types", ","))


def _matched(spark, d):
    return notify.match_policies(_notes(spark, d), policies(spark, d), standin(spark, d, "channels"))


@register("nt1_notifications", "SELECT event_id, ntype AS type, severity, title, detail, fact_key FROM note", SETS)
def nt1(spark, d):
    return _notes(spark, d).select("event_id", "type", "severity", "title", "detail", "fact_key")


@register("jn19_policy_match", "SELECT event_id, policy_id, channel_id, severity FROM matched", SETS)
def jn19(spark, d):
    return _matched(spark, d).select("event_id", "policy_id", "channel_id", "severity")


@register("nt2_dedupe", "SELECT dedup_key, event_id, policy_id FROM first_notes", SETS)
def nt2(spark, d):
    return notify.dedupe(_matched(spark, d)).select("dedup_key", "event_id", "policy_id")


@register("nt3_rate_limit", """
    SELECT dedup_key, CASE WHEN position <= 2 THEN 'sent' ELSE 'deferred' END AS outcome, position, CASE WHEN position > 2 THEN 60 END AS retry_in_seconds
    FROM (SELECT dedup_key, row_number() OVER (PARTITION BY channel_id, date_trunc('hour', ts) ORDER BY ts, event_id, dedup_key) AS position FROM (SELECT * REPLACE (date_trunc('hour', ts) + to_seconds(CAST(event_id % 60 AS BIGINT)) AS ts) FROM matched))""", SETS)
def nt3(spark, d):
    # the table has about one event per four minutes; fold an hour into a minute so that the limit bites
    folded = _matched(spark, d).withColumn("ts", F.date_trunc("hour", "ts") + F.make_interval(secs=F.col("event_id") % 60)).withColumn("dedup_key", notify.dedup_key())
    return notify.rate_limit(folded, 2).select("dedup_key", "outcome", "position", "retry_in_seconds")


@register("nt4_delivery_outcome", """
    SELECT delivery_id, CASE WHEN e IS NULL THEN 'sent' WHEN e = 'config' THEN 'failed' WHEN n >= 4 THEN 'failed' ELSE 'retry' END AS outcome, CASE WHEN e = 'transient' AND n < 4 THEN [30, 120, 480][n] END AS retry_in_seconds
    FROM (SELECT event_id AS delivery_id, CAST(user_id % 4 + 1 AS INTEGER) AS n, CASE event_id % 3 WHEN 0 THEN 'config' WHEN 1 THEN 'transient' END AS e FROM events)""")
def nt4(spark, d):
    a = standin(spark, d, "facet_obs").selectExpr("seq AS delivery_id", "CAST(asset_id % 4 + 1 AS INT) AS attempts", "CASE seq % 3 WHEN 0 THEN 'config' WHEN 1 THEN 'transient' END AS error")
    return notify.delivery_outcome(a).select("delivery_id", "outcome", "retry_in_seconds")


@register("nt5_due_retries", "SELECT delivery_id FROM deliveries WHERE status = 'pending' AND created_at <= TIMESTAMP '2024-01-20' ORDER BY created_at, delivery_id LIMIT 100")
def nt5(spark, d):
    pending = standin(spark, d, "deliveries").filter("status = 'pending'").withColumnRenamed("created_at", "due_at")
    return notify.due_retries(pending, F.lit("2024-01-20").cast("timestamp"), limit=100).select("delivery_id")


@register("nt6_render", "SELECT event_id, CASE WHEN program_name IS NOT NULL THEN '[' || program_name || '] ' ELSE '' END || upper(severity) || ' ' || title || chr(10) || detail AS text FROM note", SETS)
def nt6(spark, d):
    return notify.render(_notes(spark, d)).select("event_id", "text")
