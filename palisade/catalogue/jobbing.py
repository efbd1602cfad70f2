"""Planning and recovery over the job table."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue.platform import POOL, _QUEUES
from palisade.catalogue.registry import register
from palisade.catalogue.scoping import _DECIDED, _HITS, _RULES
from palisade.catalogue.standins import NOW, standin, table
from palisade.functions.common import literal_table
from palisade.operators import jobs
from palisade.operators.scope import evaluate_scope

_now = lambda: F.lit(NOW).cast("timestamp")

_TARGET = "CASE page_id % 5 WHEN 0 THEN host WHEN 1 THEN url WHEN 2 THEN '-bad.' || host WHEN 3 THEN host ELSE '10.' || CAST(page_id % 256 AS STRING) || '.0.0/16' END"
_PLAN_TARGETS = f"""
    SELECT DISTINCT t AS target, t AS value, CASE WHEN t LIKE 'http%' THEN 'url' WHEN t LIKE '-bad%' THEN 'bad' WHEN t LIKE '10.%' THEN 'cidr' ELSE 'domain' END AS kind,
           CASE WHEN t LIKE 'http%' THEN regexp_extract(t, '^https?://([^/:?#]+)', 1) WHEN t LIKE '-bad%' OR t LIKE '10.%' THEN NULL ELSE t END AS host,
           CASE WHEN t LIKE 'https:%' THEN 'https' WHEN t LIKE 'http:%' THEN 'http' END AS scheme, CASE WHEN regexp_extract(t, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(t, '^https?://[^/?#]+([^?#]*)', 1) END AS path
    FROM (SELECT {_TARGET.replace('STRING', 'VARCHAR')} AS t FROM http_obs)"""


@register("job1_plan", """
    SELECT t.target, s.scanner, CASE WHEN t.kind = 'bad' THEN 'INVALID_TARGET' WHEN NOT COALESCE(d.allowed, t.kind = 'cidr') THEN CASE WHEN d.match_kind = 'explicit_exclusion' THEN 'EXCLUDED' ELSE 'NOT_IN_SCOPE' END
            WHEN NOT (t.kind = 'domain' OR (t.kind = 'url' AND s.scanner = 'httpx') OR (t.kind = 'cidr' AND s.scanner = 'mapcidr')) OR (t.kind = 'domain' AND s.scanner = 'mapcidr') THEN 'UNSUPPORTED_TARGET'
            WHEN s.scanner = 'dns' THEN 'POLICY_DISABLED' WHEN t.kind = 'cidr' THEN 'CIDR_LIMIT_EXCEEDED' END AS block_reason,
           CASE WHEN t.kind = 'bad' THEN 'BLOCKED' WHEN NOT COALESCE(d.allowed, t.kind = 'cidr') THEN 'OUT_OF_SCOPE'
            WHEN NOT (t.kind = 'domain' OR (t.kind = 'url' AND s.scanner = 'httpx') OR (t.kind = 'cidr' AND s.scanner = 'mapcidr')) OR (t.kind = 'domain' AND s.scanner = 'mapcidr') OR s.scanner = 'dns' OR t.kind = 'cidr' THEN 'BLOCKED' ELSE 'PENDING' END AS status
    FROM scope_targets t CROSS JOIN (VALUES ('dns'), ('httpx'), ('mapcidr')) AS s(scanner) LEFT JOIN (SELECT * FROM scope_decided WHERE program_id = 'P1') d ON d.target = t.target""",
          {"scope_targets": _PLAN_TARGETS, "scope_rules": _RULES, "scope_hits": _HITS, "scope_decided": _DECIDED})
def job1(spark, d):
    from palisade.operators.scope import scope_rules

    targets = standin(spark, d, "http_obs").selectExpr(f"{_TARGET} AS target").distinct().withColumns({"program_id": F.lit("P1"), "asset_id": F.lit(None).cast("string")})
    rules = standin(spark, d, "rule_rows").unionByName(literal_table(spark, [("n1", "P1", "cidr", "include", "10.0.0.0/8")], "rule_id string, program_id string, type string, mode string, value string"))
    decisions = evaluate_scope(targets.select("target", "program_id"), scope_rules(rules))
    scanners = literal_table(spark, [("dns",), ("httpx",), ("mapcidr",)], "scanner string")
    out = jobs.plan(targets, scanners, decisions, enabled=F.col("scanner") != "dns")
    return out.select("target", "scanner", "block_reason", "status")


@register("job2_guards", f"""
    SELECT j.job_id, CASE WHEN p.program_id IS NULL OR NOT p.active OR p.deleted_at IS NOT NULL THEN 'PROGRAM_INACTIVE' WHEN EXISTS (SELECT 1 FROM controls c WHERE c.scanner = j.scanner AND c.paused) THEN 'SCANNER_PAUSED'
            WHEN a.paused OR a.status IN ('blocked', 'retired') THEN 'ASSET_PAUSED'
            WHEN EXISTS (SELECT 1 FROM windows w WHERE w.start <= TIMESTAMP '{NOW}' AND w."end" > TIMESTAMP '{NOW}' AND (w.program_id IS NULL OR w.program_id = j.program_id) AND (w.scanner IS NULL OR w.scanner = j.scanner)
                 AND (w.asset_id IS NULL OR w.asset_id = j.asset_id)) THEN 'MAINTENANCE_WINDOW' END AS guard
    FROM (SELECT *, job_id % 500 AS asset_id FROM jobs) j LEFT JOIN programs p ON p.program_id = j.program_id LEFT JOIN assets a ON a.asset_id = j.asset_id""")
def job2(spark, d):
    planned = standin(spark, d, "jobs").select("job_id", "program_id", "scanner", (F.col("job_id") % 500).alias("asset_id"))
    out = jobs.guards(planned, *[standin(spark, d, t) for t in ("programs", "controls", "assets", "windows")], _now())
    return out.select("job_id", "guard")


_KEYED = """
    SELECT job_id, SHA(CAST(program_id AS VARCHAR) || '|' || worker_id || '|' || scanner || '|' || CASE WHEN job_id % 2 = 0 THEN 'pol' ELSE '-' END || '|' || CAST(CAST(floor(epoch_us(created_at) / 1000000 / 31536000) AS BIGINT) AS VARCHAR)
        || CASE WHEN job_id % 9 = 0 THEN '|n' || CAST(job_id AS VARCHAR) ELSE '' END) AS key FROM jobs"""


@register("job3_idempotency", "SELECT job_id, key, row_number() OVER (PARTITION BY key ORDER BY job_id) > 1 AS duplicate FROM keyed", {"keyed": _KEYED})
def job3(spark, d):
    j = standin(spark, d, "jobs").withColumn("seq", F.col("job_id"))
    policy = F.when(F.col("job_id") % 2 == 0, "pol")
    plain = jobs.idempotency_key(F.col("program_id"), F.col("worker_id"), F.col("scanner"), policy, F.col("created_at"), 31_536_000)
    nonce = jobs.idempotency_key(F.col("program_id"), F.col("worker_id"), F.col("scanner"), policy, F.col("created_at"), 31_536_000, F.concat(F.lit("n"), F.col("job_id").cast("string")))
    keyed = j.withColumn("key", F.when(F.col("job_id") % 9 == 0, nonce).otherwise(plain))
    return jobs.dedupe_plan(keyed, "key").select("job_id", "key", "duplicate")


_AT = "TIMESTAMP '1998-01-01 00:00:00'"


@register("job4_stuck_jobs", f"""
    SELECT job_id, CASE WHEN status = 'QUEUED' THEN 'reset' WHEN retry_count < max_retries THEN 'retry' ELSE 'fail' END AS action, CASE WHEN status = 'QUEUED' OR retry_count < max_retries THEN 'PENDING' ELSE 'FAILED' END AS new_status,
           CASE WHEN status = 'RUNNING' AND retry_count < max_retries THEN retry_count + 1 ELSE retry_count END AS new_retry_count
    FROM jobs j WHERE (status = 'QUEUED' AND queued_at < {_AT} - INTERVAL 1800 SECOND) OR (status = 'RUNNING' AND started_at < {_AT} - INTERVAL 60 SECOND
        AND NOT (worker_id IN (SELECT worker_id FROM workers) AND started_at > {_AT} - INTERVAL 1200 SECOND))""")
def job4(spark, d):
    out = jobs.stuck_jobs(standin(spark, d, "jobs"), standin(spark, d, "workers"), F.lit("1998-01-01 00:00:00").cast("timestamp"))
    return out.select("job_id", "action", "new_status", "new_retry_count")


@register("job5_retry_plan", """
    SELECT job_id, CASE WHEN again THEN 'retry' ELSE 'dead_letter' END AS outcome, CASE WHEN again THEN retry_count + 1 ELSE retry_count END AS new_retry_count, CASE WHEN again THEN CAST(30 * pow(2, retry_count) AS BIGINT) END AS delay_seconds
    FROM (SELECT *, job_id % 10 = 1 OR (job_id % 7 <> 0 AND retry_count < max_retries) AS again FROM jobs WHERE status = 'FAILED')""")
def job5(spark, d):
    failed = standin(spark, d, "jobs").filter("status = 'FAILED'").withColumns({"permanent": F.col("job_id") % 7 == 0, "backlog_full": F.col("job_id") % 10 == 1})
    return jobs.retry_plan(failed).select("job_id", "outcome", "new_retry_count", "delay_seconds")


@register("job6_replayable", """
    SELECT l.job_id, l.queue, CASE WHEN j.status = 'FAILED' THEN 'replayed' ELSE 'skipped' END AS outcome FROM (SELECT job_id, scanner AS queue FROM jobs WHERE job_id % 3 = 0
        QUALIFY row_number() OVER (PARTITION BY scanner ORDER BY created_at, job_id) <= 30) l LEFT JOIN jobs j ON l.job_id = j.job_id""")
def job6(spark, d):
    j = standin(spark, d, "jobs")
    dead = j.filter("job_id % 3 = 0").select(F.col("scanner").alias("queue"), F.struct("created_at", "job_id").alias("position"), "job_id")
    return jobs.replayable(dead, j, limit=30).select("job_id", "queue", "outcome")


@register("job7_feasible", """
    SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN 'no_templates' WHEN CAST(p_partkey % 20 * 100 AS DOUBLE) / p_size > 60 * 0.8 THEN 'too_slow' ELSE 'ok' END AS verdict FROM part WHERE p_size > 0""")
def job7(spark, d):
    sel = table(spark, d, "part").filter("p_size > 0").selectExpr("p_partkey", "p_partkey % 20 * 100 AS templates", "p_size AS rate_limit", "60 AS deadline_seconds")
    return jobs.feasible(sel).select("p_partkey", "verdict")


@register("job8_job_documents", """
    SELECT job_id, 'JOB_' || status AS type, CAST(job_id AS VARCHAR) AS doc_id, CAST(epoch_us(finished_at) - epoch_us(started_at) AS DOUBLE) / 1000000 AS duration_seconds, scanner AS tool, CAST(priority AS VARCHAR) AS priority, block_reason FROM jobs""")
def job8(spark, d):
    ev = jobs.job_docs(standin(spark, d, "jobs"))
    at = lambda p: F.get_json_object("payload", p)
    return ev.select("job_id", "type", "doc_id", "duration_seconds", at("$.scan.tool").alias("tool"), at("$.job.priority").alias("priority"), at("$.job.block_reason").alias("block_reason"))


@register("st8_queue_metrics", "SELECT 'QUEUE_DEPTH' AS type, queue AS queue_name, pending, workers, busy_workers FROM pool", {"queues": _QUEUES, "pool": POOL})
def st8(spark, d):
    return jobs.queue_metrics(standin(spark, d, "jobs"), standin(spark, d, "workers"), _now()).select("type", "queue_name", "pending", "workers", "busy_workers")


