"""Snapshot comparison and keyed merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue.registry import register
from palisade.catalogue.standins import NOW, NOW_US, standin, table
from palisade.operators import merge, sync

_now = lambda: F.lit(NOW).cast("timestamp")


@register("set1_snapshot_diff", """
    SELECT COALESCE(p.host, c.host) AS host, CASE WHEN p.host IS NULL THEN 'added' WHEN c.host IS NULL THEN 'removed' ELSE 'unchanged' END AS status
    FROM (SELECT DISTINCT host FROM host_list WHERE page_id % 10 <> 0) p FULL JOIN (SELECT DISTINCT host FROM host_list WHERE page_id % 10 <> 1) c ON p.host = c.host""")
def set1(spark, d):
    pages = standin(spark, d, "host_list")
    return sync.snapshot_diff(pages.filter("page_id % 10 <> 0"), pages.filter("page_id % 10 <> 1"), ["host"])


@register("set2_import", f"""
    WITH old AS (SELECT host, max(page_id) % 4 = 0 AS gone FROM host_list WHERE page_id % 5 <> 0 GROUP BY host), new AS (SELECT DISTINCT host FROM host_list WHERE page_id % 5 <> 1)
    SELECT COALESCE(o.host, n.host) AS value, CASE WHEN n.host IS NOT NULL AND (o.host IS NULL OR o.gone) THEN 'added' WHEN n.host IS NULL AND NOT o.gone THEN 'removed' WHEN n.host IS NOT NULL THEN 'unchanged' ELSE 'absent' END AS status,
           CASE WHEN n.host IS NOT NULL THEN NULL WHEN o.gone THEN '2023-12-01' ELSE '{NOW[:10]}' END AS removed_on, n.host IS NOT NULL AS scope_active
    FROM old o FULL JOIN new n ON o.host = n.host""")
def set2(spark, d):
    from palisade.sources.records import parse_domain_list

    pages = standin(spark, d, "host_list")
    old = pages.filter("page_id % 5 <> 0").groupBy(F.col("host").alias("value")).agg(
        F.when(F.max("page_id") % 4 == 0, F.lit("2023-12-01").cast("timestamp")).alias("removed_at")
    ).selectExpr("value", "'domain' AS type", "TIMESTAMP '2023-11-01' AS first_seen", "TIMESTAMP '2023-11-01' AS last_seen", "removed_at")
    lines = pages.filter("page_id % 5 <> 1").select(F.concat(F.lit("  "), F.upper("host")).alias("value"))
    entries, _ = parse_domain_list(lines)
    out = sync.import_scope(old, entries, _now())
    return out.select("value", "status", F.date_format("removed_at", "yyyy-MM-dd").alias("removed_on"), "scope_active")


@register("set3_range_sync", """
    SELECT provider, CAST(count(*) FILTER (WHERE status = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (WHERE status = 'removed') AS BIGINT) AS removed, CAST(count(*) FILTER (WHERE status = 'unchanged') AS BIGINT) AS unchanged
    FROM (SELECT COALESCE(p.provider, c.provider) AS provider, CASE WHEN c.cidr IS NOT NULL AND (p.cidr IS NULL OR p.gone) THEN 'added' WHEN c.cidr IS NULL AND NOT p.gone THEN 'removed' WHEN c.cidr IS NOT NULL THEN 'unchanged' ELSE 'absent' END AS status
        FROM (SELECT provider, cidr, plen = 16 AS gone FROM cloud_ranges WHERE length(cidr) % 5 <> 0) p FULL JOIN (SELECT provider, cidr FROM cloud_ranges WHERE plen <> 8) c ON p.provider = c.provider AND p.cidr = c.cidr)
    GROUP BY provider""")
def set3(spark, d):
    ranges = standin(spark, d, "cloud_ranges")
    prev = ranges.filter("length(cidr) % 5 <> 0").selectExpr(
        "provider", "cidr", "TIMESTAMP '2023-11-01' AS first_seen", "TIMESTAMP '2023-11-01' AS last_seen", "CASE WHEN plen = 16 THEN TIMESTAMP '2023-12-01' END AS removed_at"
    )
    return sync.sync_stats(sync.sync_ranges(prev, ranges.filter("plen <> 8"), _now()), ["provider"])


@register("set4_kev_sync", """
    SELECT COALESCE(p.cve_id, c.cve_id) AS cve_id, CASE WHEN c.cve_id IS NOT NULL AND (p.cve_id IS NULL OR p.removed_at IS NOT NULL) THEN 'KEV_ADDED'
        WHEN c.cve_id IS NOT NULL AND (p.product <> c.product) THEN 'KEV_UPDATED' WHEN c.cve_id IS NULL AND p.removed_at IS NULL THEN 'KEV_REMOVED' END AS event_type, c.cve_id IS NOT NULL AS in_catalog
    FROM kev_prev p FULL JOIN kev_cur c ON p.cve_id = c.cve_id""")
def set4(spark, d):
    prev = sync.with_content_hash(standin(spark, d, "kev_prev").select("cve_id", "vendor", "product", "removed_at"))
    cur = sync.with_content_hash(standin(spark, d, "kev_cur"))
    return sync.sync_kev(prev, cur).select("cve_id", "event_type", "in_catalog")


@register("set5_array_difference", """
    SELECT seq, array_to_string(list_sort(list_distinct(list_filter(cur, lambda x: NOT list_contains(prev, x)))), ',') AS added, array_to_string(list_sort(list_distinct(list_filter(prev, lambda x: NOT list_contains(cur, x)))), ',') AS removed
    FROM (SELECT seq, ['t' || CAST(k % 5 AS VARCHAR), 't' || CAST(k % 7 AS VARCHAR)] AS cur, ['t' || CAST(k % 3 AS VARCHAR), 't' || CAST(k % 4 AS VARCHAR)] AS prev FROM facet_obs)""")
def set5(spark, d):
    df = standin(spark, d, "facet_obs").selectExpr(
        "seq", "array('t' || (k % 5), 't' || (k % 7)) AS cur", "array('t' || (k % 3), 't' || (k % 4)) AS prev"
    )
    diff = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return df.select("seq", diff("cur", "prev").alias("added"), diff("prev", "cur").alias("removed"))


@register("set6_target_union", """
    SELECT target, part, seq FROM (SELECT host AS target, 0 AS part, page_id AS seq FROM host_list WHERE page_id % 2 = 0 UNION ALL SELECT host, 1, page_id FROM host_list WHERE page_id % 3 = 0)
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY part, seq) = 1""")
def set6(spark, d):
    p = standin(spark, d, "host_list").select(F.col("host").alias("target"), F.col("page_id").alias("seq"))
    return sync.target_union(p.filter("seq % 2 = 0"), p.filter("seq % 3 = 0"))


# --- merges --------------------------------------------------------------------------------------------------


@register("mrg1_keyed_merge", """
    SELECT COALESCE(c.k, n.k) AS k, COALESCE(c.first_us, n.first_us) AS first_us, CASE WHEN n.k IS NOT NULL THEN n.last_ip ELSE c.last_ip END AS last_ip,
           greatest(c.max_asn, n.max_asn) AS max_asn, least(c.min_us, n.min_us) AS min_us, c.k IS NULL AS inserted
    FROM (SELECT asset_id AS k, min(us) AS first_us, arg_max(ip, seq) AS last_ip, max(asn) AS max_asn, min(us) AS min_us FROM facet_obs WHERE seq % 3 = 0 AND asset_id % 4 <> 0 GROUP BY 1) c
    FULL JOIN (SELECT asset_id AS k, arg_min(us, seq) AS first_us, arg_max(ip, seq) AS last_ip, max(asn) AS max_asn, min(us) AS min_us FROM facet_obs WHERE seq % 3 <> 0 AND asset_id % 5 <> 0 GROUP BY 1) n ON c.k = n.k""")
def mrg1(spark, d):
    obs = standin(spark, d, "facet_obs")
    cur = obs.filter("seq % 3 = 0 AND asset_id % 4 <> 0").groupBy(F.col("asset_id").alias("k")).agg(
        F.min("us").alias("first_us"), F.max_by("ip", "seq").alias("last_ip"), F.max("asn").alias("max_asn"), F.min("us").alias("min_us")
    )
    new = obs.filter("seq % 3 <> 0 AND asset_id % 5 <> 0").selectExpr("asset_id AS k", "us AS first_us", "ip AS last_ip", "asn AS max_asn", "us AS min_us", "seq")
    return merge.merge(cur, new, ["k"], {"first_us": "first", "last_ip": "last", "max_asn": "greatest", "min_us": "least"}, ["seq"])


_ASSET_OBS = (
    "'url' AS asset_type", "fingerprint || '-' || CAST(asset_id AS STRING) AS value", "timestamp_micros(us) AS seen_at",
    "CAST(CASE k % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence", "'s' || CAST(k % 3 AS STRING) AS source", "'why ' || CAST(seq AS STRING) AS reason", "seq",
)


@register("mrg2_upsert_assets", f"""
    WITH o AS (SELECT fingerprint || '-' || CAST(asset_id AS VARCHAR) AS value, us, CAST(CASE k % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS conf, 'why ' || CAST(seq AS VARCHAR) AS why, seq FROM facet_obs),
         n AS (SELECT value, min(us) AS first_us, max(us) AS last_us FROM o GROUP BY 1), b AS (SELECT value, conf, why FROM o QUALIFY row_number() OVER (PARTITION BY value ORDER BY conf DESC, us, seq) = 1),
         c AS (SELECT DISTINCT 'fp' || CAST(s % 10 AS VARCHAR) || '-' || CAST(c_custkey % 200 AS VARCHAR) AS value FROM customer, (VALUES (1), (3), (7)) AS t(s))
    SELECT COALESCE(n.value, c.value) AS value, CASE WHEN c.value IS NULL THEN first_us ELSE 1000000 END AS first_us, greatest(CASE WHEN c.value IS NOT NULL THEN 1000000 END, last_us) AS last_us,
           CASE WHEN c.value IS NULL OR conf > 0.7 THEN conf ELSE CAST(0.7 AS DOUBLE) END AS confidence, CASE WHEN c.value IS NULL OR conf > 0.7 THEN why ELSE 'before' END AS reason, c.value IS NULL AS inserted
    FROM n LEFT JOIN b ON n.value = b.value FULL JOIN c ON n.value = c.value""")
def mrg2(spark, d):
    obs = standin(spark, d, "facet_obs").selectExpr(*_ASSET_OBS)
    cur = table(spark, d, "customer").selectExpr("explode(array('fp1', 'fp3', 'fp7')) AS fp", "c_custkey % 200 AS c").distinct().selectExpr(
        "'url' AS asset_type", "fp || '-' || CAST(c AS STRING) AS value", "'active' AS status", "'HTTP_PROBED' AS lifecycle_stage", "timestamp_micros(1000000) AS first_seen",
        "timestamp_micros(1000000) AS last_seen", "CAST(0.7 AS DOUBLE) AS confidence_score", "'old' AS confidence_source", "'before' AS confidence_reason",
    )
    out = merge.upsert_assets(cur, obs)
    return out.select(
        "value", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), F.col("confidence_score").alias("confidence"),
        F.col("confidence_reason").alias("reason"), "inserted",
    )


@register("mrg3_program_links", """
    SELECT COALESCE(n.p, c.p) AS program_id, COALESCE(n.a, c.a) AS asset_id, COALESCE(n.status, c.status) AS status, COALESCE(n.why, 'before') AS scope_reason, greatest(n.us, c.us) AS last_us, c.p IS NULL AS inserted
    FROM (SELECT asn AS p, asset_id AS a, CASE k % 3 WHEN 0 THEN 'in_scope' WHEN 1 THEN 'excluded' ELSE 'out_of_scope' END AS status, 'r' || CAST(seq AS VARCHAR) AS why, us FROM facet_obs
          QUALIFY row_number() OVER (PARTITION BY asn, asset_id ORDER BY us DESC, seq DESC) = 1) n
    FULL JOIN (SELECT 64500 AS p, c_custkey AS a, 'in_scope' AS status, c_custkey % 2 * 4102444800000000 AS us FROM customer) c ON n.p = c.p AND n.a = c.a""")
def mrg3(spark, d):
    decisions = standin(spark, d, "facet_obs").selectExpr(
        "asn AS program_id", "asset_id", "k % 3 = 0 AS allowed", "CASE k % 3 WHEN 1 THEN 'explicit_exclusion' ELSE 'none' END AS match_kind", "CAST(NULL AS STRING) AS scope_id",
        "'r' || CAST(seq AS STRING) AS reason", "timestamp_micros(us) AS seen_at", "seq",
    )
    cur = table(spark, d, "customer").selectExpr(
        "CAST(64500 AS BIGINT) AS program_id", "c_custkey AS asset_id", "'in_scope' AS status", "CAST(NULL AS STRING) AS scope_id", "'before' AS scope_reason",
        "timestamp_micros(0) AS first_seen", "timestamp_micros(c_custkey % 2 * 4102444800000000) AS last_seen",  # half of them newer than any observation
    )
    return merge.link_assets(cur, decisions).select("program_id", "asset_id", "status", "scope_reason", F.unix_micros("last_seen").alias("last_us"), "inserted")


@register("mrg4_upsert_edges", """
    SELECT COALESCE(n.s, c.s) AS source_id, COALESCE(n.t, c.t) AS target_id, COALESCE(n.r, c.r) AS relationship_type, CASE WHEN c.s IS NOT NULL THEN 'before' ELSE n.meta END AS metadata,
           greatest(n.last_us, c.us) AS last_us, c.s IS NULL AS inserted
    FROM (SELECT l_suppkey AS s, target_id % 20 AS t, relationship_type AS r, arg_min('m' || CAST(source_id AS VARCHAR), (us, source_id * 10 + l_linenumber, l_extendedprice)) AS meta, max(us) AS last_us
          FROM edges WHERE l_linenumber % 5 <> 0 GROUP BY 1, 2, 3) n
    FULL JOIN (SELECT l_suppkey AS s, target_id % 20 AS t, relationship_type AS r, max(us) AS us FROM edges WHERE l_linenumber % 5 = 0 GROUP BY 1, 2, 3) c ON n.s = c.s AND n.t = c.t AND n.r = c.r""")
def mrg4(spark, d):
    e = standin(spark, d, "edges")
    key = ["l_suppkey AS source_id", "target_id % 20 AS target_id", "relationship_type"]
    cur = e.filter("l_linenumber % 5 = 0").selectExpr(*key, "us").groupBy(*merge.EDGE_KEY).agg(F.timestamp_micros(F.max("us")).alias("last_seen")).selectExpr(
        *merge.EDGE_KEY, "'old' AS source", "CAST(1 AS DOUBLE) AS confidence", "'before' AS metadata", "last_seen AS first_seen", "last_seen"
    )
    new = e.filter("l_linenumber % 5 <> 0").selectExpr(
        *key, "'x' AS source", "CAST(0.5 AS DOUBLE) AS confidence", "'m' || CAST(source_id AS STRING) AS metadata", "timestamp_micros(us) AS seen_at",
        "struct(source_id * 10 + l_linenumber AS a, l_extendedprice AS b) AS seq",
    )
    return merge.upsert_edges(cur, new).select(*merge.EDGE_KEY, "metadata", F.unix_micros("last_seen").alias("last_us"), "inserted")


@register("mrg5_swap_state", """
    SELECT asset_id, fingerprint AS state, lag(fingerprint) OVER w AS previous FROM (SELECT asset_id, fingerprint, us, seq FROM facet_obs UNION ALL SELECT c_custkey, 'old', 0, -1 FROM customer WHERE c_custkey % 2 = 0)
    WINDOW w AS (PARTITION BY asset_id ORDER BY us, seq) QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY us DESC, seq DESC) = 1""")
def mrg5(spark, d):
    obs = standin(spark, d, "facet_obs").selectExpr("asset_id", "'tls' AS facet", "fingerprint AS state", "timestamp_micros(us) AS observed_at", "seq")
    cur = table(spark, d, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey AS asset_id", "'tls' AS facet", "'old' AS state", "timestamp_micros(0) AS observed_at")
    return merge.swap_state(cur, obs).select("asset_id", "state", "previous")


@register("mrg6_mark_scanned", """
    WITH o AS (SELECT asset_id, max(us) AS at, max(CASE WHEN k % 4 = 0 THEN us END) AS changed, max_by(CASE WHEN k % 3 = 0 THEN 'HTTP_PROBED' ELSE 'CRAWLED' END, (us, seq)) FILTER (WHERE k % 5 <> 0) AS stage,
               max_by(k % 2 = 0, (us, seq)) FILTER (WHERE k % 7 <> 0) AS act, bool_or(k % 2 = 0) FILTER (WHERE k % 7 <> 0) AS any_act FROM facet_obs GROUP BY 1)
    SELECT a.asset_id, CASE WHEN o.act THEN 'active' WHEN o.act = false AND (a.status IN ('discovered', 'active') OR any_act) THEN 'inactive' ELSE a.status END AS status,
           COALESCE(o.stage, 'DISCOVERED') AS lifecycle_stage, greatest(o.at, CASE WHEN a.asset_id % 3 = 0 THEN 4102444800000000 END) AS scanned_us, greatest(o.changed, CASE WHEN a.asset_id % 3 = 1 THEN 4102444800000000 END) AS changed_us FROM assets a LEFT JOIN o ON a.asset_id = o.asset_id""")
def mrg6(spark, d):
    cur = standin(spark, d, "assets").selectExpr(
        "asset_id", "status", "'DISCOVERED' AS lifecycle_stage", "CASE WHEN asset_id % 3 = 0 THEN timestamp_micros(4102444800000000) END AS last_scanned",
        "CASE WHEN asset_id % 3 = 1 THEN timestamp_micros(4102444800000000) END AS last_changed", "last_seen",
    )
    obs = standin(spark, d, "facet_obs").selectExpr(
        "asset_id", "timestamp_micros(us) AS scanned_at", "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'HTTP_PROBED' ELSE 'CRAWLED' END AS stage", "k % 4 = 0 AS changed",
        "CASE WHEN k % 7 <> 0 THEN k % 2 = 0 END AS active", "seq",
    )
    out = merge.mark_scanned(cur, obs)
    return out.select("asset_id", "status", "lifecycle_stage", F.unix_micros("last_scanned").alias("scanned_us"), F.unix_micros("last_changed").alias("changed_us"))


def correlations(spark, d):
    """(current, new) correlations over parts."""
    p = table(spark, d, "part")
    cve = "'CVE-2024-' || CAST(p_partkey AS STRING) AS cve_id"
    cur = p.filter("p_partkey % 3 = 0").selectExpr(
        "p_partkey % 50 AS asset_id", cve, "'cpe-correlation' AS source", "'potential' AS status", "'old' AS technology", "'1' AS version", "'c' AS cpe", "CAST(0.8 AS DOUBLE) AS cpe_confidence",
        "p_partkey % 2 = 0 AS in_kev", "timestamp_micros(0) AS first_seen", "timestamp_micros(0) AS last_seen",
    )
    new = p.filter("p_partkey % 4 <> 1").selectExpr(
        "p_partkey % 50 AS asset_id", cve, "'cpe-correlation' AS source", "CASE WHEN p_size % 2 = 0 THEN 'potential' ELSE 'detected' END AS status", "p_brand AS technology",
        "CAST(p_size AS STRING) AS version", "CAST(NULL AS STRING) AS cpe", "CAST(0.5 AS DOUBLE) AS cpe_confidence", f"timestamp_micros({NOW_US}) AS seen_at", "p_partkey AS seq",
    )
    return cur, new


CORRELATED = """
    SELECT COALESCE(n.p_partkey, c.p_partkey) AS pk, COALESCE(n.p_partkey, c.p_partkey) % 50 AS asset_id, 'CVE-2024-' || CAST(COALESCE(n.p_partkey, c.p_partkey) AS VARCHAR) AS cve_id,
           CASE WHEN n.p_partkey IS NULL THEN 'potential' WHEN n.p_size % 2 = 0 THEN 'potential' ELSE 'detected' END AS status,
           CASE WHEN c.p_partkey IS NOT NULL THEN 'old' ELSE n.p_brand END AS technology, CASE WHEN n.p_partkey IS NOT NULL THEN CAST(n.p_size AS VARCHAR) ELSE '1' END AS version,
           CASE WHEN n.p_partkey IS NULL THEN 'c' END AS cpe, CASE WHEN n.p_partkey IS NOT NULL THEN n.p_partkey % 10 <> 0 AND n.p_partkey % 20 <> 3 ELSE c.p_partkey % 2 = 0 END AS in_kev,
           COALESCE(c.p_partkey % 2 = 0, false) AS was_kev, c.p_partkey IS NULL AS inserted, n.p_partkey IS NOT NULL AS touched
    FROM (SELECT * FROM part WHERE p_partkey % 4 <> 1) n FULL JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) c ON n.p_partkey = c.p_partkey"""


@register("mrg7_correlations", "SELECT asset_id, cve_id, status, technology, version, cpe, in_kev, was_kev, inserted FROM correlated", {"correlated": CORRELATED})
def mrg7(spark, d):
    cur, new = correlations(spark, d)
    kev = standin(spark, d, "kev_prev").filter("removed_at IS NULL")
    return merge.upsert_correlations(cur, new, kev).select("asset_id", "cve_id", "status", "technology", "version", "cpe", "in_kev", "was_kev", "inserted")


@register("mrg8_feed_upserts", """
    SELECT COALESCE(n.cve_id, o.cve_id) AS cve_id, COALESCE(n.d, o.description) AS description, CASE WHEN n.cve_id IS NOT NULL THEN n.s ELSE o.cvss_severity END AS cvss_severity, o.cve_id IS NULL AS inserted
    FROM cves o FULL JOIN (SELECT 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve_id, 'new ' || p_name AS d, p_type AS s FROM part WHERE p_size % 5 = 0) n ON o.cve_id = n.cve_id""")
def mrg8(spark, d):
    cur = standin(spark, d, "cves").select("cve_id", "description", "cvss_severity")
    new = table(spark, d, "part").filter("p_size % 5 = 0").selectExpr(
        "'CVE-2024-' || CAST(p_partkey AS STRING) AS cve_id", "explode(array('stale ' || p_name, 'new ' || p_name)) AS description", "p_type AS cvss_severity"
    ).withColumn("seq", F.when(F.startswith("description", F.lit("new")), 2).otherwise(1))
    return merge.upsert_last(cur, new, ["cve_id"], ["seq"])


@register("mrg9_add_scope", """
    WITH c AS (SELECT program_id, type, value, mode, active FROM scope_entries),
         n AS (SELECT program_id, type, value, CASE WHEN program_id % 3 = 0 THEN 'exclude' ELSE mode END AS mode FROM scope_entries WHERE length(value) % 3 <> 0 OR NOT active)
    SELECT COALESCE(c.program_id, n.program_id) AS program_id, COALESCE(c.value, n.value) AS value, COALESCE(c.mode, n.mode) AS mode,
           CASE WHEN c.value IS NULL THEN 'inserted' WHEN n.value IS NOT NULL AND NOT c.active THEN 'reactivated' WHEN n.value IS NOT NULL THEN 'conflict' ELSE 'unchanged' END AS outcome,
           CASE WHEN c.value IS NULL OR (n.value IS NOT NULL AND NOT c.active) THEN 'manual' ELSE 'import' END AS source, c.value IS NULL OR n.value IS NOT NULL OR c.active AS active
    FROM c FULL JOIN n ON c.program_id = n.program_id AND c.type = n.type AND c.value = n.value AND c.mode = n.mode""")
def mrg9(spark, d):
    entries = standin(spark, d, "scope_entries")
    cur = entries.selectExpr("program_id", "type", "value", "mode", "'import' AS source", "active")
    new = entries.filter("length(value) % 3 <> 0 OR NOT active").selectExpr(
        "program_id", "type", "value", "CASE WHEN program_id % 3 = 0 THEN 'exclude' ELSE mode END AS mode", "'manual' AS source", "explode(array(1, 2)) AS seq"
    )
    return merge.add_scope(cur, new).select("program_id", "value", "mode", "outcome", "source", "active")
