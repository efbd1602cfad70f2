"""Technologies x vulnerability feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue.registry import register
from palisade.catalogue.standins import NOW, standin, table
from palisade.operators import vuln
from palisade.plans.correlation import correlation_events, correlation_plan

_now = lambda: F.lit(NOW).cast("timestamp")

# technology assets 100000.. and edges asset -> technology with the version in the edge
_CPE = "'cpe:2.3:a:' || CASE technology WHEN 'nginx' THEN 'f5:nginx' WHEN 'apache-httpd' THEN 'apache:http_server' WHEN 'php' THEN 'php:php' ELSE 'jquery:jquery' END || ':' || version || ':*:*:*:*:*:*:*'"
_OBS = f"SELECT asset_id, technology, version, {_CPE} AS cpe FROM tech_obs WHERE version IS NOT NULL AND technology <> 'hsts'"
# each CPE has three CVEs; every seventh lookup is stale
_LOOKUP = f"""
    SELECT cpe, unnest(['CVE-2024-' || CAST(m AS VARCHAR), 'CVE-2024-' || CAST(m + 1 AS VARCHAR), 'CVE-2024-' || CAST(m + 11 AS VARCHAR)]) AS cve_id, m
    FROM (SELECT cpe, min(asset_id) AS m FROM obs GROUP BY cpe) WHERE m % 7 <> 0"""
_PAIRS = "SELECT o.asset_id, o.technology, o.version, o.cpe, l.cve_id FROM obs o JOIN lookups l ON o.cpe = l.cpe"
SETS = {"obs": _OBS, "lookups": _LOOKUP, "pairs": _PAIRS}


def tech_edges(spark, d):
    """(edges, assets) carrying the technology observations."""
    t = standin(spark, d, "tech_obs")
    edges = t.selectExpr(
        "asset_id AS source_id", "'t-' || technology AS target_id", "'USES_TECHNOLOGY' AS relationship_type", "CAST(0.8 AS DOUBLE) AS confidence", "version",
        "CAST(0.7 AS DOUBLE) AS version_confidence", "CAST(NULL AS STRING) AS cpe",
    )
    others = t.selectExpr("asset_id AS source_id", "'x' AS target_id", "'HAS_URL' AS relationship_type", "CAST(1 AS DOUBLE) AS confidence", "version", "CAST(1 AS DOUBLE) AS version_confidence", "CAST(NULL AS STRING) AS cpe")
    assets = t.selectExpr("'t-' || technology AS asset_id", "technology AS value").distinct()
    return edges.unionByName(others), assets


def lookups(spark, d):
    edges, assets = tech_edges(spark, d)
    return vuln.tech_observations(edges, assets).groupBy("cpe").agg(F.min("asset_id").alias("m")).selectExpr(
        "cpe", "array('CVE-2024-' || m, 'CVE-2024-' || (m + 1), 'CVE-2024-' || (m + 11)) AS cve_ids",
        f"CASE WHEN m % 7 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '{NOW}' - INTERVAL 1 DAY END AS fetched_at",
    )


@register("jn15_tech_observations", "SELECT asset_id, technology, version, cpe FROM obs", SETS)
def jn15(spark, d):
    return vuln.tech_observations(*tech_edges(spark, d)).select("asset_id", "technology", "version", "cpe")


@register("jn16_cves_for_cpe", "SELECT asset_id, cpe, cve_id FROM pairs", SETS)
def jn16(spark, d):
    obs = vuln.tech_observations(*tech_edges(spark, d))
    return vuln.cves_for_cpe(obs, lookups(spark, d), _now()).select("asset_id", "cpe", "cve_id")


@register("jn17_enrich", """
    SELECT p.asset_id, p.cve_id, c.description, c.cvss_severity, e.score AS epss_score, k.cve_id IS NOT NULL AS kev_in_catalog, k.vendor AS kev_vendor
    FROM pairs p LEFT JOIN cves c ON p.cve_id = c.cve_id LEFT JOIN epss e ON p.cve_id = e.cve_id LEFT JOIN (SELECT * FROM kev_prev WHERE removed_at IS NULL) k ON p.cve_id = k.cve_id""", SETS)
def jn17(spark, d):
    obs = vuln.tech_observations(*tech_edges(spark, d))
    pairs = vuln.cves_for_cpe(obs, lookups(spark, d), _now())
    out = vuln.enrich_vuln(pairs, cve_records(spark, d), standin(spark, d, "epss"), standin(spark, d, "kev_prev"))
    return out.select("asset_id", "cve_id", "description", "cvss_severity", "epss_score", "kev_in_catalog", "kev_vendor")


def cve_records(spark, d):
    return standin(spark, d, "cves").selectExpr(
        "cve_id", "description", "CAST(NULL AS TIMESTAMP) AS published", "cvss_score", "'3.1' AS cvss_version", "CAST(NULL AS STRING) AS cvss_vector", "cvss_severity"
    )


_MEMBERS = "SELECT l.asset_id, l.program_id, p.name AS program_name FROM links l JOIN programs p ON l.program_id = p.program_id WHERE l.status = 'in_scope' AND p.deleted_at IS NULL"


@register("jn18_asset_programs", "SELECT t.asset_id, t.technology, m.program_id, m.program_name FROM tech_obs t LEFT JOIN members m ON t.asset_id = m.asset_id", {"members": _MEMBERS})
def jn18(spark, d):
    rows = standin(spark, d, "tech_obs").select("asset_id", "technology")
    return vuln.asset_programs(rows, standin(spark, d, "links"), standin(spark, d, "programs"))


def _run(spark, d):
    edges, assets = tech_edges(spark, d)
    cur = table(spark, d, "part").filter("p_partkey % 3 = 0").selectExpr(
        "p_partkey AS asset_id", "'CVE-2024-' || CAST(p_partkey AS STRING) AS cve_id", "'cpe-correlation' AS source", "'potential' AS status", "'old' AS technology", "'1' AS version", "'c' AS cpe",
        "CAST(0.8 AS DOUBLE) AS cpe_confidence", "p_partkey % 2 = 0 AS in_kev", "timestamp_micros(0) AS first_seen", "timestamp_micros(0) AS last_seen",
    )
    return correlation_plan(
        edges, assets, lookups(spark, d), cve_records(spark, d), standin(spark, d, "epss"), standin(spark, d, "kev_prev"), standin(spark, d, "links"),
        standin(spark, d, "programs"), cur, _now(), max_cpes=None,
    )


_CUR = "SELECT p_partkey AS asset_id, 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve_id, p_partkey % 2 = 0 AS was FROM part WHERE p_partkey % 3 = 0"
_RUN = """
    SELECT COALESCE(p.asset_id, c.asset_id) AS asset_id, COALESCE(p.cve_id, c.cve_id) AS cve_id, CASE WHEN c.cve_id IS NOT NULL THEN 'old' ELSE p.technology END AS technology, p.cve_id IS NOT NULL AS touched,
           c.cve_id IS NULL AS inserted, COALESCE(c.was, false) AS was, k.cve_id IS NOT NULL AS kev FROM pairs p FULL JOIN cur c ON p.asset_id = c.asset_id AND p.cve_id = c.cve_id
    LEFT JOIN (SELECT cve_id FROM kev_prev WHERE removed_at IS NULL) k ON k.cve_id = COALESCE(p.cve_id, c.cve_id)"""
RUN = {**SETS, "cur": _CUR, "run": _RUN, "members": _MEMBERS}


@register("ob12_correlation_changes", """
    SELECT r.asset_id, r.cve_id, m.program_id, t.change_type FROM run r LEFT JOIN (SELECT DISTINCT asset_id, program_id FROM members) m ON r.asset_id = m.asset_id
    JOIN (VALUES ('NEW_CVE'), ('KEV_ADDED')) AS t(change_type) ON (t.change_type = 'NEW_CVE' AND inserted) OR (t.change_type = 'KEV_ADDED' AND kev AND NOT was) WHERE r.touched""", RUN)
def ob12(spark, d):
    return _run(spark, d).extra["changes"].select("asset_id", "cve_id", "program_id", "change_type")


@register("ob12_correlation_documents", """
    SELECT r.asset_id, r.cve_id, r.technology, m.program_name, CASE WHEN r.kev THEN 'true' ELSE 'false' END AS in_catalog, c.cvss_severity AS severity
    FROM run r LEFT JOIN members m ON r.asset_id = m.asset_id LEFT JOIN cves c ON r.cve_id = c.cve_id""", RUN)
def ob12b(spark, d):
    ev = correlation_events(_run(spark, d).rows, standin(spark, d, "links"), standin(spark, d, "programs"))
    at = lambda p: F.get_json_object("payload", p)
    return ev.select("asset_id", "cve_id", at("$.technology.name").alias("technology"), at("$.program.name").alias("program_name"), at("$.kev.in_catalog").alias("in_catalog"), at("$.cvss.severity").alias("severity"))


@register("ob12_correlation_counts", """
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM obs) AS observations, (SELECT CAST(count(DISTINCT cpe) AS BIGINT) FROM obs) AS cpes, (SELECT CAST(count(*) AS BIGINT) FROM pairs) AS correlations""", SETS)
def ob12c(spark, d):
    plan = _run(spark, d)
    obs = plan.extra["observations"].agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("cpe").alias("cpes")).withColumn("one", F.lit(1))
    n = plan.extra["correlations"].agg(F.count(F.lit(1)).alias("correlations")).withColumn("one", F.lit(1))
    return obs.join(n, "one").drop("one")


