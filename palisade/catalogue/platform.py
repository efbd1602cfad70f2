"""Lists, counters and rankings over the platform tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue.registry import register
from palisade.catalogue.standins import NOW, NOW_US, spark_sql, standin, table
from palisade.operators import aggregates, jobs, ranking, reads
from palisade.plans.panels import Where, recent

_now = lambda: F.lit(NOW).cast("timestamp")
_AT_NOW = f"TIMESTAMP '{NOW}'"


# --- reads ---------------------------------------------------------------------------------------------------


@register("flt1_list_assets", """
    SELECT asset_id, value, status FROM assets a WHERE status = 'active' AND value LIKE '%1%' AND EXISTS (SELECT 1 FROM links l WHERE l.asset_id = a.asset_id AND l.program_id = 3)
    ORDER BY last_seen DESC, asset_id LIMIT 20 OFFSET 2""")
def flt1(spark, d):
    out = reads.list_assets(standin(spark, d, "assets"), standin(spark, d, "links"), program=3, status="active", q="1", limit=20, offset=2)
    return out.select("asset_id", "value", "status")


@register("flt2_asset_detail", """
    SELECT a.asset_id, a.asset_type, s.section, s.key, s.detail FROM assets a LEFT JOIN (SELECT asset_id, 'program' AS section, CAST(program_id AS VARCHAR) AS key, status AS detail FROM links
        UNION ALL SELECT asset_id, 'state', facet, state FROM states) s ON a.asset_id = s.asset_id""")
def flt2(spark, d):
    out = reads.asset_detail(standin(spark, d, "assets"), standin(spark, d, "links"), standin(spark, d, "states"))
    return out.select("asset_id", "asset_type", "section", "key", "detail")


@register("flt3_list_scope", "SELECT type, value, mode FROM scope_entries WHERE program_id = 3 AND active")
def flt3(spark, d):
    return reads.list_scope(standin(spark, d, "scope_entries"), 3).select("type", "value", "mode")


@register("flt4_list_programs", "SELECT program_id, slug, active FROM programs WHERE deleted_at IS NULL AND active")
def flt4(spark, d):
    return reads.list_programs(standin(spark, d, "programs"), active_only=True).select("program_id", "slug", "active")


@register("flt5_scan_detail", "SELECT scan_id, status, CAST(count(*) AS BIGINT) AS jobs FROM jobs GROUP BY ALL")
def flt5(spark, d):
    return reads.scan_detail(standin(spark, d, "jobs"))


@register("flt5_list_scans", """
    SELECT scan_id, program_id FROM (SELECT scan_id, min(program_id) AS program_id, min(created_at) AS created_at FROM jobs GROUP BY scan_id) ORDER BY created_at DESC, scan_id LIMIT 100""")
def flt5b(spark, d):
    scans = standin(spark, d, "jobs").groupBy("scan_id").agg(F.min("program_id").alias("program_id"), F.min("created_at").alias("created_at"))
    return reads.list_scans(scans, limit=100).select("scan_id", "program_id")


@register("flt6_list_jobs", "SELECT job_id, scan_id, priority FROM jobs WHERE status = 'QUEUED' AND scanner = 'httpx' ORDER BY created_at DESC, job_id LIMIT 100")
def flt6(spark, d):
    return reads.list_jobs(standin(spark, d, "jobs"), status="QUEUED", scanner="httpx", limit=100).select("job_id", "scan_id", "priority")


@register("flt7_list_audit", "SELECT audit_id, action FROM audit WHERE action = 'SCOPE_BLOCKED' ORDER BY ts DESC, audit_id LIMIT 100")
def flt7(spark, d):
    return reads.list_audit(standin(spark, d, "audit"), "SCOPE_BLOCKED", limit=100).select("audit_id", "action")


@register("flt8_list_deliveries", "SELECT delivery_id, status FROM deliveries WHERE status = 'failed' ORDER BY created_at DESC, delivery_id LIMIT 100")
def flt8(spark, d):
    return reads.list_deliveries(standin(spark, d, "deliveries"), "failed", limit=100).select("delivery_id", "status")


@register("flt9_open_windows", f"""SELECT window_id, program_id, scanner, asset_id FROM windows WHERE start <= {_AT_NOW} AND "end" > {_AT_NOW}""")
def flt9(spark, d):
    return reads.open_windows(standin(spark, d, "windows"), _now()).select("window_id", "program_id", "scanner", "asset_id")


@register("flt9_list_windows", "SELECT window_id, scanner FROM windows ORDER BY start DESC, window_id LIMIT 200")
def flt9b(spark, d):
    return reads.list_windows(standin(spark, d, "windows"), limit=200).select("window_id", "scanner")


@register("flt10_due_schedules", f"SELECT schedule_id, scanner FROM schedules WHERE enabled AND (next_run_at IS NULL OR next_run_at <= {_AT_NOW})")
def flt10(spark, d):
    return reads.due_schedules(standin(spark, d, "schedules"), _now()).select("schedule_id", "scanner")


@register("flt13_predicates", f"""
    SELECT job_id FROM (SELECT job_id, scanner, status, block_reason, AT({NOW_US} - (job_id * 7919 % 5184000) * 1000000) AS ts FROM jobs)
    WHERE ts BETWEEN {_AT_NOW} - INTERVAL 30 DAY AND {_AT_NOW} AND status IN ('BLOCKED', 'FAILED') AND (scanner IS NULL OR scanner <> 'dns') AND (block_reason IS NOT NULL) AND ts >= {_AT_NOW} - INTERVAL 240 HOUR""")
def flt13(spark, d):
    df = standin(spark, d, "jobs").withColumn("ts", F.expr(spark_sql(f"AT({NOW_US} - (job_id * 7919 % 5184000) * 1000000)")))
    where = Where(equals={"status": ("BLOCKED", "FAILED")}, differs={"scanner": ("dns",)}, exists=("block_reason",), hours=240)
    return df.filter(recent(_now()) & where.column(_now())).select("job_id")


@register("jn13_program_targets", """
    SELECT l.program_id, a.asset_id, a.value, NOT COALESCE(a.value LIKE '%.example.com' AND a.asset_type <> 'url', false) AS skipped
    FROM links l JOIN assets a ON l.asset_id = a.asset_id WHERE l.status = 'in_scope' AND a.asset_type IN ('domain', 'subdomain', 'ipv4', 'ipv6') AND NOT a.paused AND a.status NOT IN ('retired', 'blocked')""")
def jn13(spark, d):
    from palisade.operators.scope import scope_rules

    # every program includes *.example.com
    rules = scope_rules(standin(spark, d, "programs").selectExpr(
        "'r' || CAST(program_id AS STRING) AS rule_id", "program_id", "'wildcard' AS type", "'include' AS mode", "'*.example.com' AS value"
    ))
    return reads.program_targets(standin(spark, d, "assets"), standin(spark, d, "links"), rules)


@register("jn14_neighbours", """
    SELECT e.source_id AS asset_id, 'outgoing' AS direction, e.relationship_type, e.target_id AS other_id, a.value AS other_value FROM edges e JOIN assets a ON e.target_id = a.asset_id
    UNION ALL SELECT e.target_id, 'incoming', e.relationship_type, e.source_id, a.value FROM edges e JOIN assets a ON e.source_id = a.asset_id""")
def jn14(spark, d):
    out = reads.neighbours(standin(spark, d, "edges"), standin(spark, d, "assets"))
    return out.select("asset_id", "direction", "relationship_type", "other_id", "other_value")


@register("jn20_schedule_targets", """
    WITH usable AS (SELECT program_id FROM programs WHERE active AND deleted_at IS NULL),
         accepts AS (SELECT * FROM (VALUES ('httpx', 'domain'), ('httpx', 'subdomain'), ('httpx', 'ipv4'), ('httpx', 'ipv6'), ('httpx', 'url'), ('dns', 'domain'), ('dns', 'subdomain'), ('katana', 'domain'), ('katana', 'subdomain'), ('katana', 'url')) AS t(scanner, asset_type))
    SELECT s.schedule_id, u.program_id, s.scanner, a.asset_id FROM schedules s JOIN usable u ON s.program_id IS NULL OR s.program_id = u.program_id JOIN links l ON l.program_id = u.program_id AND l.status = 'in_scope'
    JOIN assets a ON a.asset_id = l.asset_id AND NOT a.paused JOIN accepts c ON c.scanner = s.scanner AND c.asset_type = a.asset_type""")
def jn20(spark, d):
    sched = standin(spark, d, "schedules").select("schedule_id", "program_id", F.array("scanner").alias("scanners"))
    return reads.schedule_targets(sched, standin(spark, d, "programs"), standin(spark, d, "assets"), standin(spark, d, "links"))


# --- aggregates ----------------------------------------------------------------------------------------------


@register("ag1_stats", """
    SELECT 'programs.total' AS metric, CAST(NULL AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n FROM programs WHERE deleted_at IS NULL UNION ALL SELECT 'programs.active', NULL, count(*) FROM programs WHERE deleted_at IS NULL AND active
    UNION ALL SELECT 'scope_entries', NULL, count(*) FROM scope_entries WHERE active UNION ALL SELECT 'assets', asset_type, count(*) FROM assets GROUP BY asset_type UNION ALL SELECT 'relationships', NULL, count(*) FROM edges
    UNION ALL SELECT 'jobs', status, count(*) FROM jobs GROUP BY status UNION ALL SELECT 'scope_blocked', NULL, count(*) FROM audit WHERE action = 'SCOPE_BLOCKED'""")
def ag1(spark, d):
    return aggregates.stats(*[standin(spark, d, t) for t in ("programs", "scope_entries", "assets", "edges", "jobs", "audit")])


@register("ag2_job_counts", "SELECT scanner, status, CAST(count(*) AS BIGINT) AS jobs FROM jobs GROUP BY ALL")
def ag2(spark, d):
    return aggregates.job_counts(standin(spark, d, "jobs"))


@register("ag2_job_gauges", "SELECT scanner, CAST(count(*) FILTER (WHERE status = 'RUNNING') AS BIGINT) AS running, CAST(count(*) FILTER (WHERE status = 'FAILED') AS BIGINT) AS failed FROM jobs GROUP BY ALL")
def ag2b(spark, d):
    return aggregates.job_gauges(standin(spark, d, "jobs"))


@register("ag3_avg_duration", "SELECT scanner, round(avg(CAST(epoch_us(finished_at) - epoch_us(started_at) AS DOUBLE) / 1000000), 6) AS avg_seconds FROM jobs WHERE status = 'SUCCESS' GROUP BY scanner")
def ag3(spark, d):
    return aggregates.avg_duration(standin(spark, d, "jobs")).select("scanner", F.round("avg_seconds", 6).alias("avg_seconds"))


@register("ag4_asset_counts", "SELECT asset_type, CAST(count(*) AS BIGINT) AS assets, CAST(count(last_scanned) AS BIGINT) AS scanned FROM assets GROUP BY asset_type")
def ag4(spark, d):
    return aggregates.asset_counts(standin(spark, d, "assets"))


_CORR = "SELECT p_partkey % 50 AS asset_id, 'CVE-2024-' || CAST(p_partkey * 3 % 2000 AS VARCHAR) AS cve_id, CASE WHEN p_size % 2 = 0 THEN 'potential' ELSE 'detected' END AS status FROM part"


@register("ag5_vuln_counts", """
    SELECT 'cve_matches' AS metric, status AS key, CAST(count(*) AS BIGINT) AS n FROM corr GROUP BY status
    UNION ALL SELECT 'kev_matches', NULL, count(DISTINCT cve_id) FROM corr WHERE cve_id IN (SELECT cve_id FROM kev_prev WHERE removed_at IS NULL)""", {"corr": _CORR})
def ag5(spark, d):
    corr = table(spark, d, "part").selectExpr(
        "p_partkey % 50 AS asset_id", "'CVE-2024-' || CAST(p_partkey * 3 % 2000 AS STRING) AS cve_id", "CASE WHEN p_size % 2 = 0 THEN 'potential' ELSE 'detected' END AS status"
    )
    return aggregates.vuln_counts(corr, standin(spark, d, "kev_prev"))


@register("ag6_delivery_counts", "SELECT status, CAST(count(*) AS BIGINT) AS deliveries FROM deliveries GROUP BY status")
def ag6(spark, d):
    return aggregates.delivery_counts(standin(spark, d, "deliveries"))


@register("ag7_oldest_queued", f"SELECT scanner, greatest(CAST({NOW_US} - min(epoch_us(queued_at)) AS DOUBLE) / 1000000, 0) AS oldest_seconds FROM jobs WHERE status = 'QUEUED' GROUP BY scanner")
def ag7(spark, d):
    return aggregates.oldest_queued(standin(spark, d, "jobs"), _now())


_QUEUES = "SELECT * FROM (VALUES ('bbot', 'bbot'), ('dns', 'dns'), ('httpx', 'httpx'), ('katana', 'katana'), ('mapcidr', 'mapcidr'), ('nuclei', 'nuclei'), ('tlsx', 'tlsx'), ('uncover', 'discovery')) AS t(scanner, queue)"
POOL = f"""
    SELECT q.queue, COALESCE(pending, 0) AS pending, COALESCE(high, 0) AS high_priority, COALESCE(w.workers, 0) AS workers, COALESCE(w.busy, 0) AS busy_workers, oldest AS oldest_seconds FROM queues q
    LEFT JOIN (SELECT scanner, CAST(count(*) AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE priority >= 7) AS BIGINT) AS high, greatest(CAST({NOW_US} - min(epoch_us(queued_at)) AS DOUBLE) / 1000000, 0) AS oldest FROM jobs WHERE status = 'QUEUED' GROUP BY scanner) j ON q.scanner = j.scanner
    LEFT JOIN (SELECT queue, CAST(count(*) AS BIGINT) AS workers, CAST(count(current_job) AS BIGINT) AS busy FROM workers GROUP BY queue) w ON q.queue = w.queue"""


@register("ag8_pool_report", "SELECT * FROM pool", {"queues": _QUEUES, "pool": POOL})
def ag8(spark, d):
    return aggregates.pool_report(standin(spark, d, "jobs"), standin(spark, d, "workers"), _now())


@register("ag9_scan_status", """
    SELECT scan_id, CAST(count(*) AS BIGINT) AS jobs, CAST(count(*) FILTER (WHERE status NOT IN ('SUCCESS', 'FAILED', 'CANCELLED', 'BLOCKED', 'OUT_OF_SCOPE')) AS BIGINT) AS open_jobs,
           CASE WHEN bool_and(status IN ('SUCCESS', 'FAILED', 'CANCELLED', 'BLOCKED', 'OUT_OF_SCOPE')) THEN 'COMPLETED' ELSE 'RUNNING' END AS scan_status FROM jobs GROUP BY scan_id""")
def ag9(spark, d):
    return aggregates.scan_status(standin(spark, d, "jobs"))


@register("ag10_plan_summary", """
    SELECT CASE WHEN dup THEN 'DUPLICATE' ELSE status END AS outcome, CAST(count(*) AS BIGINT) AS jobs
    FROM (SELECT status, row_number() OVER (PARTITION BY program_id, scanner, priority ORDER BY job_id) > 1 AS dup FROM jobs) GROUP BY ALL""")
def ag10(spark, d):
    keyed = standin(spark, d, "jobs").withColumns({"k": F.concat_ws("|", "program_id", "scanner", "priority"), "seq": F.col("job_id")})
    return aggregates.plan_summary(jobs.dedupe_plan(keyed, "k"))


@register("ag11_distinct", "SELECT CAST(count(DISTINCT worker_id) AS BIGINT) AS value FROM jobs")
def ag11(spark, d):
    return ranking.distinct_count(standin(spark, d, "jobs"), "worker_id")


@register("ag11_distinct_approx", "SELECT CAST(count(DISTINCT ip_int) AS BIGINT) AS exact, true AS close FROM ip_rows")
def ag11b(spark, d):
    """The exact number, and whether the sketch estimate lies within 5 % of it."""
    rows = standin(spark, d, "ip_rows")
    both = ranking.distinct_count(rows, "ip_int").withColumnRenamed("value", "exact").crossJoin(ranking.distinct_count(rows, "ip_int", exact=False))
    return both.select("exact", (F.abs(F.col("value") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@register("ag12_count", "SELECT CAST(count(*) AS BIGINT) AS jobs FROM jobs WHERE status = 'FAILED'")
def ag12(spark, d):
    return standin(spark, d, "jobs").filter("status = 'FAILED'").agg(F.count(F.lit(1)).alias("jobs"))


@register("ag13_bucket_metrics", """
    SELECT k1, value FROM (SELECT scanner AS k1, round(avg(job_id % 900), 6) AS value FROM jobs WHERE status = 'SUCCESS' GROUP BY scanner ORDER BY avg(job_id % 900) DESC, scanner LIMIT 3)
    UNION ALL SELECT k1, value FROM (SELECT worker_id AS k1, CAST(max(priority) AS DOUBLE) AS value FROM jobs GROUP BY worker_id ORDER BY max(priority) DESC, worker_id LIMIT 5)""")
def ag13(spark, d):
    j = standin(spark, d, "jobs").withColumn("duration", F.col("job_id") % 900)
    a = ranking.terms_table(j.filter("status = 'SUCCESS'"), ["scanner"], 3, F.avg("duration")).select("k1", F.round("value", 6).alias("value"))
    b = ranking.terms_table(j, ["worker_id"], 5, F.max("priority")).select("k1", F.col("value").cast("double").alias("value"))
    return a.unionByName(b)


@register("ag14_run_summary", """
    SELECT program_id, CAST(count(*) FILTER (WHERE page % 10 <> 7) AS BIGINT) AS records, CAST(count(*) FILTER (WHERE page % 10 <> 7 AND page % 3 <> 0) AS BIGINT) AS accepted,
           CAST(count(*) FILTER (WHERE page % 10 <> 7 AND page % 3 = 0) AS BIGINT) AS scope_blocked, CAST(count(*) FILTER (WHERE page % 10 = 7) AS BIGINT) AS malformed,
           CAST(count(*) FILTER (WHERE page % 10 <> 7 AND page % 3 <> 0 AND page % 4 = 0) AS BIGINT) AS critical FROM (SELECT program_id, job_id AS page FROM jobs) GROUP BY program_id""")
def ag14(spark, d):
    rows = standin(spark, d, "jobs").selectExpr("program_id", "job_id % 10 = 7 AS malformed", "job_id % 3 <> 0 AS allowed", "CASE WHEN job_id % 4 = 0 THEN 'critical' ELSE 'low' END AS severity")
    out = aggregates.run_summary(rows, ["program_id"])
    return out.select("program_id", "records", "accepted", "scope_blocked", "malformed", F.col("severity_critical").alias("critical"))


@register("ag15_merge_technologies", """
    SELECT s_suppkey, technology, version, seq FROM (SELECT l_suppkey AS s_suppkey, 't' || CAST(l_partkey % 20 AS VARCHAR) AS technology, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber AS VARCHAR) END AS version,
        CASE WHEN l_quantity > 25 THEN 0.9 ELSE 0.8 END AS confidence, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY s_suppkey, technology ORDER BY version IS NULL, confidence DESC, seq) = 1""")
def ag15(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_suppkey AS s_suppkey", "'t' || CAST(l_partkey % 20 AS STRING) AS name", "CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber AS STRING) END AS version",
        "CASE WHEN l_quantity > 25 THEN 0.9 ELSE 0.8 END AS confidence", "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq",
    )
    return aggregates.best_technology(rows, ["s_suppkey"]).select("s_suppkey", F.col("name").alias("technology"), "version", "seq")


@register("ag17_url_inventory", """
    SELECT host, regexp_replace(norm_url, '^https?://[^/]+([^?]*).*$', '\\1') AS path, CAST(count(DISTINCT norm_url) AS BIGINT) AS urls
    FROM (SELECT *, split_part(norm_url, '?', 1) || '|' || regexp_replace(regexp_extract(norm_url, '[?](.*)$', 1), '=[^&]*', '', 'g') AS endpoint FROM http_obs) GROUP BY host, endpoint, path""")
def ag17(spark, d):
    from palisade.functions.urls import normalize_urls

    df = normalize_urls(standin(spark, d, "http_obs").select("page_id", "url"), "url").select(
        F.col("u.host").alias("host"), F.col("u.url_hash").alias("url_hash"), F.col("u.endpoint_hash").alias("endpoint_hash"), F.col("u.path").alias("endpoint"), F.col("page_id").alias("seq")
    )
    urls = aggregates.url_inventory(df, ["host"])
    return aggregates.endpoint_inventory(urls, ["host"]).select("host", F.col("endpoint").alias("path"), "urls")


@register("ag18_open_ports", """
    SELECT asset_id, string_agg(CAST(port AS VARCHAR), ',' ORDER BY port) AS ports FROM (SELECT DISTINCT asset_id, 8000 + k AS port FROM facet_obs) GROUP BY asset_id""")
def ag18(spark, d):
    obs = standin(spark, d, "facet_obs").select(F.col("asset_id").alias("host"), (8000 + F.col("k")).alias("port"))
    return aggregates.open_ports(obs).select(F.col("host").alias("asset_id"), F.array_join(F.col("ports").cast("array<string>"), ",").alias("ports"))


# --- rankings ------------------------------------------------------------------------------------------------


@register("wn1_fair_share_rank", f"""
    SELECT job_id, rank FROM (SELECT job_id, priority, created_at, row_number() OVER (PARTITION BY program_id, scanner ORDER BY priority DESC, created_at, job_id) AS rank FROM jobs
        WHERE status = 'PENDING' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{NOW}')) ORDER BY rank, priority DESC, created_at, job_id LIMIT 500""")
def wn1(spark, d):
    return ranking.fair_share_rank(standin(spark, d, "jobs"), 500, _now()).select("job_id", "rank")


@register("wn1_full_rank", "SELECT job_id, row_number() OVER (PARTITION BY program_id, scanner ORDER BY priority DESC, created_at, job_id) AS rank FROM jobs WHERE status = 'PENDING'")
def wn1b(spark, d):
    return ranking.fair_share_rank(standin(spark, d, "jobs")).select("job_id", "rank")


@register("wn2_fair_share_admit", """
    WITH q AS (SELECT program_id, scanner, count(*) AS n FROM jobs WHERE status = 'QUEUED' GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY program_id, scanner ORDER BY priority DESC, created_at, job_id) AS rank FROM jobs WHERE status = 'PENDING')
    SELECT job_id FROM r LEFT JOIN q USING (program_id, scanner) WHERE priority >= 7 OR COALESCE(n, 0) + rank - 1 < 5""")
def wn2(spark, d):
    return ranking.fair_share_admit(standin(spark, d, "jobs"), 5).select("job_id")


@register("wn4_terms", """
    SELECT key, CAST(count(*) AS BIGINT) AS value FROM (SELECT seq, unnest(list_distinct(['t' || CAST(k % 7 AS VARCHAR), 't' || CAST(k % 5 AS VARCHAR)])) AS key FROM facet_obs) GROUP BY key ORDER BY value DESC, key LIMIT 4""")
def wn4(spark, d):
    df = standin(spark, d, "facet_obs").selectExpr("seq", "array('t' || (k % 7), 't' || (k % 5), NULL) AS tags")
    return ranking.terms(df, "tags", 4)


@register("wn5_nested_terms", """
    WITH a AS (SELECT scanner AS k1, count(*) AS n FROM jobs GROUP BY 1 ORDER BY n DESC, k1 LIMIT 4),
         b AS (SELECT scanner AS k1, status AS k2, count(*) AS n FROM jobs WHERE scanner IN (SELECT k1 FROM a) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k1 ORDER BY n DESC, k2) <= 4),
         c AS (SELECT scanner AS k1, status AS k2, worker_id AS k3, count(*) AS n FROM jobs j WHERE EXISTS (SELECT 1 FROM b WHERE b.k1 = j.scanner AND b.k2 = j.status) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY n DESC, k3) <= 4)
    SELECT k1, k2, k3, CAST(n AS BIGINT) AS value FROM c""")
def wn5(spark, d):
    return ranking.terms_table(standin(spark, d, "jobs"), ["scanner", "status", "worker_id"], 4)


@register("wn6_time_series", """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, event_type AS key, CAST(count(*) AS BIGINT) AS value FROM events
    WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 3) GROUP BY ALL""")
def wn6(spark, d):
    out = ranking.timeseries(table(spark, d, "events"), "ts", "day", "event_type", 3)
    return out.select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "key", "value")


@register("wn7_cap_per_group", "SELECT asset_id, seq FROM facet_obs QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY SHA(CAST(seq AS VARCHAR))) <= 20")
def wn7(spark, d):
    from palisade.functions.common import sha256

    df = standin(spark, d, "facet_obs")
    return ranking.cap_per_group(df.withColumn("h", sha256(F.col("seq").cast("string"))), ["asset_id"], [F.asc("h")], 20).select("asset_id", "seq")


@register("wn8_last_import", "SELECT scanner AS source, arg_max(job_id, (created_at, job_id)) AS run_id FROM jobs GROUP BY scanner")
def wn8(spark, d):
    runs = standin(spark, d, "jobs").select(F.col("scanner").alias("source"), F.col("created_at").alias("imported_at"), F.col("job_id").alias("run_id"))
    return ranking.last_import(runs).select("source", "run_id")


