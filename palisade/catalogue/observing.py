"""Observation plans fed with tool output made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue.attributing import ASN_UNIQUE, asns, cloud
from palisade.catalogue.parsing import CT_MESSAGE
from palisade.catalogue.registry import register
from palisade.catalogue.scoping import _URLS, _ctes, rules_of
from palisade.catalogue.standins import NOW, dotted, spark_sql, standin, table
from palisade.operators import changes
from palisade.plans import certificates as ct_plans
from palisade.plans import crawl, discovery, dns, findings, http, tls
from palisade.plans.base import pair_states
from palisade.sources.certificates import parse_ct

_now = lambda: F.lit(NOW).cast("timestamp")
_INT = "(page_id * 2654435761 + 97) % 4294967296"
_IP = dotted(_INT)


def _lines(spark, d, record, **extra):
    """Pages as JSON lines; every tenth page gives a line that is not JSON."""
    df = standin(spark, d, "http_obs").withColumn("ip", F.expr(_IP))
    value = F.when(F.col("page_id") % 10 == 9, F.lit("not json")).otherwise(F.to_json(record))
    return df.select(
        F.lit("P1").alias("program_id"), F.concat(F.lit("j"), (F.col("page_id") % 5).cast("string")).alias("job_id"), "ts", F.col("ts").alias("observed_at"),
        F.col("page_id").alias("seq"), value.alias("value"), *[c.alias(n) for n, c in extra.items()],
    ).drop("ts")


# --- HTTP ----------------------------------------------------------------------------------------------------


def _http(spark, d):
    tech = F.when(F.col("page_id") % 3 == 0, F.array(F.concat(F.lit("Nginx:1."), (F.col("page_id") % 7).cast("string")), F.lit("HSTS"))).when(
        F.col("page_id") % 3 == 1, F.array(F.lit("PHP:8.1"))
    )
    record = F.struct(
        "url", "status_code", "webserver", "title", F.col("ip").alias("host_ip"), F.concat((F.col("page_id") % 90).cast("string"), F.lit("ms")).alias("time"), tech.alias("tech"),
        (F.col("page_id") % 8 == 7).alias("failed"),
    )
    return http.http_plan(_lines(spark, d, record), rules_of(spark), cloud(spark, d), asns(spark, d))


_HTTP_TECHS = """array_to_string(list_sort(list_filter([CASE WHEN page_id % 3 = 0 THEN 'hsts:' END,
    CASE WHEN page_id % 4 = 0 THEN 'nginx:1.24.0' WHEN page_id % 3 = 0 THEN 'nginx:1.' || CAST(page_id % 7 AS VARCHAR) END, CASE WHEN page_id % 3 = 1 THEN 'php:8.1' END,
    CASE page_id % 4 WHEN 1 THEN 'apache-httpd:' WHEN 2 THEN 'iis:10.0' END], lambda x: x IS NOT NULL)), ',')"""
_HTTP_ROWS = f"SELECT *, {_INT} AS ip_int, {_IP.replace('STRING', 'VARCHAR')} AS ip, {_HTTP_TECHS} AS techs FROM http_obs WHERE page_id % 10 <> 9 AND page_id % 8 <> 7"
_PAGE_CLOUD = """
    SELECT p.page_id, r.provider FROM http_rows p JOIN cloud_ranges r ON starts_with(lpad(bin(p.ip_int), 32, '0'), r.net_bits)
    QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY r.plen DESC, r.provider, r.cidr) = 1"""
_PAGE_ASN = """
    SELECT page_id, asn FROM (SELECT p.page_id, p.ip_int, r.asn, r.hi FROM http_rows p JOIN asn_unique r ON r.lo <= p.ip_int QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY r.lo DESC) = 1) WHERE hi >= ip_int"""
HTTP_SETS = {**_ctes(_URLS), "http_rows": _HTTP_ROWS, "asn_unique": ASN_UNIQUE, "page_cloud": _PAGE_CLOUD, "page_asn": _PAGE_ASN}


@register("ob1_http", """
    SELECT h.page_id AS seq, h.norm_url AS url, h.status_code, h.title, CAST(h.page_id % 90 AS DOUBLE) AS time_ms, h.ip, h.techs, COALESCE(d.allowed, false) AS allowed, COALESCE(d.reason, 'not in approved scope') AS reason, c.provider, a.asn
    FROM http_rows h LEFT JOIN scope_decided d ON h.norm_url = regexp_replace(d.target, '#.*$', '') AND d.program_id = 'P1' AND d.target = (SELECT min(url) FROM http_obs o WHERE o.norm_url = h.norm_url)
    LEFT JOIN page_cloud c ON h.page_id = c.page_id LEFT JOIN page_asn a ON h.page_id = a.page_id""", HTTP_SETS)
def ob1(spark, d):
    techs = F.array_join(F.transform("technologies", lambda t: F.concat(t["name"], F.lit(":"), F.coalesce(t["version"], F.lit("")))), ",")
    return _http(spark, d).rows.select(
        "seq", "url", "status_code", "title", "time_ms", "ip", techs.alias("techs"), "decision.allowed", "decision.reason", "cloud.provider", F.col("asn.number").alias("asn")
    )


@register("ob1_http_status_changes", """
    SELECT seq, CAST(prev AS VARCHAR) AS previous, CAST(status_code AS VARCHAR) AS current FROM (
        SELECT h.page_id AS seq, status_code, lag(status_code) OVER (PARTITION BY regexp_extract(norm_url, '^https?://[^/?]+') ORDER BY ts, page_id) AS prev
        FROM http_rows h JOIN (SELECT DISTINCT regexp_replace(target, '#.*$', '') AS u FROM scope_decided WHERE program_id = 'P1' AND allowed) d ON h.norm_url = d.u) WHERE prev IS NOT NULL AND prev <> status_code""", HTTP_SETS)
def ob1b(spark, d):
    rows = changes.diff_http(pair_states(_http(spark, d).states), ["seq"])
    return rows.filter("change_type = 'HTTP_STATUS_CHANGED'").select("seq", "previous", "current")


@register("ob1_http_edges", """
    SELECT relationship_type, CAST(count(*) AS BIGINT) AS edges FROM (
        SELECT h.page_id, h.techs, a.asn FROM http_rows h JOIN (SELECT DISTINCT regexp_replace(target, '#.*$', '') AS u FROM scope_decided WHERE program_id = 'P1' AND allowed) d ON h.norm_url = d.u LEFT JOIN page_asn a ON h.page_id = a.page_id) t,
        LATERAL (SELECT unnest(['HAS_URL', 'RESOLVES_TO'] || CASE WHEN asn IS NOT NULL THEN ['BELONGS_TO_ASN'] ELSE [] END || list_transform(CASE WHEN techs = '' THEN [] ELSE string_split(techs, ',') END, lambda x: 'USES_TECHNOLOGY')) AS relationship_type)
    GROUP BY relationship_type""", HTTP_SETS)
def ob1c(spark, d):
    return _http(spark, d).edges.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("edges"))


_OK_ROWS = """SELECT h.*, d.rule_id, d.reason FROM http_rows h JOIN scope_decided d ON d.program_id = 'P1' AND d.allowed AND d.target = (SELECT min(url) FROM http_obs o WHERE o.norm_url = h.norm_url)"""


@register("ob1_http_event_payloads", """
    SELECT h.page_id AS seq, 'HTTP_OBSERVATION' AS type, norm_url AS url, h.host AS domain, regexp_extract(norm_url, '^(https?)', 1) AS scheme, CAST(status_code AS VARCHAR) AS status_code, title, ip,
        'j' || CAST(h.page_id % 5 AS VARCHAR) AS job_id, c.provider, CAST(a.asn AS VARCHAR) AS asn
    FROM ok_rows h LEFT JOIN page_cloud c ON h.page_id = c.page_id LEFT JOIN page_asn a ON h.page_id = a.page_id""", {**HTTP_SETS, "ok_rows": _OK_ROWS})
def ob1d(spark, d):
    at = lambda p: F.get_json_object("payload", f"$.{p}")
    return http.http_events(_http(spark, d).rows).select(
        "seq", "type", at("url.full").alias("url"), at("url.domain").alias("domain"), at("url.scheme").alias("scheme"), at("http.response.status_code").alias("status_code"),
        at("http.title").alias("title"), at("host.ip").alias("ip"), at("scan.job_id").alias("job_id"), at("cloud.provider").alias("provider"), at("asn.number").alias("asn"))


@register("ob1_http_summary_rows", """
    SELECT 'j' || CAST(page_id % 5 AS VARCHAR) AS job_id, CAST(count(*) FILTER (page_id % 10 = 9) AS BIGINT) AS malformed,
        CAST(count(*) FILTER (page_id IN (SELECT page_id FROM ok_rows)) AS BIGINT) AS allowed, CAST(count(*) FILTER (page_id IN (SELECT page_id FROM http_rows) AND page_id NOT IN (SELECT page_id FROM ok_rows)) AS BIGINT) AS refused
    FROM http_obs GROUP BY 1""", {**HTTP_SETS, "ok_rows": _OK_ROWS})
def ob1e(spark, d):
    plan = _http(spark, d)
    rows = http.summary_rows(plan.extra["parsed"], plan.rows)
    return rows.groupBy("job_id").agg(F.count_if("malformed").alias("malformed"), F.count_if("allowed").alias("allowed"), F.count_if(~F.col("malformed") & ~F.col("allowed")).alias("refused"))


@register("ob1_http_links", """
    SELECT page_id AS seq, norm_url AS asset_id, true AS allowed, rule_id AS scope_id, reason FROM ok_rows""", {**HTTP_SETS, "ok_rows": _OK_ROWS})
def ob1f(spark, d):
    return http.link_decisions(_http(spark, d).states, rules_of(spark)).select("seq", "asset_id", "allowed", "scope_id", "reason")


# --- TLS -----------------------------------------------------------------------------------------------------

_SANS = "SELECT page_id, unnest(list_distinct([host, 'www.' || host, 'other.example.org'])) AS san FROM http_obs WHERE page_id % 10 <> 9 AND page_id % 6 <> 5"
_SAN_TARGETS = "SELECT DISTINCT t AS target, t AS value, 'domain' AS kind, t AS host, CAST(NULL AS VARCHAR) AS scheme, CAST(NULL AS VARCHAR) AS path FROM (SELECT host AS t FROM http_obs UNION SELECT 'www.' || host FROM http_obs UNION SELECT 'other.example.org')"


@register("ob2_tls", f"""
    SELECT h.page_id AS seq, h.host, 'fp' || CAST(h.page_id % 50 AS VARCHAR) AS fingerprint, CASE WHEN page_id * 13 % 120 - 40 < 0 THEN 'expired' WHEN page_id * 13 % 120 - 40 <= 30 THEN 'expiring' ELSE 'valid' END AS expiry_status,
           COALESCE(d.allowed, false) AS allowed, CASE WHEN d.allowed THEN (SELECT CAST(count(*) AS BIGINT) FROM sans s JOIN scope_decided x ON x.target = s.san AND x.program_id = 'P1' AND x.allowed WHERE s.page_id = h.page_id) ELSE 0 END AS sans_in_scope
    FROM http_obs h LEFT JOIN scope_decided d ON h.host = d.target AND d.program_id = 'P1' WHERE page_id % 10 <> 9 AND page_id % 6 <> 5""", {"sans": _SANS, **_ctes(_SAN_TARGETS)})
def ob2(spark, d):
    p = F.col("page_id")
    not_after = F.date_format(F.expr(f"TIMESTAMP '{NOW}' + make_dt_interval(CAST(page_id * 13 % 120 - 40 AS INT))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    record = F.struct(
        F.when(p % 6 != 5, F.struct(F.concat(F.lit("fp"), (p % 50).cast("string")).alias("sha256"))).alias("fingerprint_hash"), F.lit("443").alias("port"), F.col("ip"),
        F.array(F.col("host"), F.concat(F.lit("*."), parent), F.concat(F.lit("WWW."), F.upper("host")), F.lit("other.example.org"), F.lit("bad..name")).alias("subject_an"), not_after.alias("not_after"),
    )
    plan = tls.tls_plan(_lines(spark, d, record, host=F.col("host")), rules_of(spark), _now())
    sans = plan.extra["sans"].groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    out = plan.rows.join(sans, "seq", "left")
    return out.select("seq", "host", "fingerprint", "expiry_status", "decision.allowed", F.coalesce("n", F.lit(0)).cast("bigint").alias("sans_in_scope"))


# --- DNS -----------------------------------------------------------------------------------------------------

_LI_IP = "(l_partkey * 2654435761 + l_orderkey * 97) % 4294967296"
_ANSWER = [
    "'h' || CAST(l_orderkey AS STRING) || '.example.com' AS name", "1 AS run", "CAST(l_shipdate AS TIMESTAMP) AS observed_at", "l_linenumber AS seq",
    "CASE l_linenumber % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'CNAME' WHEN 3 THEN 'NS' ELSE 'TXT' END AS record_type",
    f"CASE l_linenumber % 5 WHEN 0 THEN {dotted(_LI_IP)} WHEN 1 THEN '2001:db8::' || HEX(l_partkey % 65535 + 1) WHEN 2 THEN 'c' || CAST(l_partkey AS STRING) || '.example.net.' WHEN 3 THEN 'ns' || CAST(l_suppkey AS STRING) || '.example.net' END AS value",
    "l_linenumber % 5 = 4 AS nxdomain",
]
_ANSWERS = "SELECT " + ", ".join(_ANSWER).replace("STRING", "VARCHAR") + f", {_LI_IP} AS ip_int FROM lineitem"


@register("ob3_dns_states", """
    SELECT name, COALESCE(string_agg(DISTINCT CASE WHEN record_type = 'A' THEN value END, ',' ORDER BY CASE WHEN record_type = 'A' THEN value END), '') AS a,
           COALESCE(string_agg(DISTINCT CASE WHEN record_type = 'NS' THEN value END, ',' ORDER BY CASE WHEN record_type = 'NS' THEN value END), '') AS ns,
           COALESCE(string_agg(DISTINCT CAST(x.asn AS VARCHAR), ',' ORDER BY CAST(x.asn AS VARCHAR)), '') AS asns, CASE WHEN bool_and(nxdomain) THEN 'NXDOMAIN' ELSE 'NOERROR' END AS status
    FROM answers t LEFT JOIN (SELECT ip_int, asn FROM (SELECT i.ip_int, r.asn, r.hi FROM (SELECT DISTINCT ip_int FROM answers WHERE record_type = 'A') i JOIN asn_unique r ON r.lo <= i.ip_int
        QUALIFY row_number() OVER (PARTITION BY i.ip_int ORDER BY r.lo DESC) = 1) WHERE hi >= ip_int) x ON t.record_type = 'A' AND t.ip_int = x.ip_int GROUP BY name""", {"answers": _ANSWERS, "asn_unique": ASN_UNIQUE})
def ob3(spark, d):
    answers = table(spark, d, "lineitem").selectExpr(*map(spark_sql, _ANSWER))
    states = dns.dns_plan(answers, cloud(spark, d), asns(spark, d)).states
    c = F.col("current")
    return states.select(
        F.col("asset_id").alias("name"), F.array_join(c["a"], ",").alias("a"), F.array_join(c["ns"], ",").alias("ns"), F.array_join(F.array_sort(c["asn"]), ",").alias("asns"), "status"
    )


@register("ob3_dns_edges", """
    SELECT name AS source_id, rtrim(value, '.') AS target_id, CASE record_type WHEN 'A' THEN 'RESOLVES_TO' WHEN 'AAAA' THEN 'RESOLVES_TO' WHEN 'CNAME' THEN 'CNAME_TO' ELSE 'USES_NAMESERVER' END AS relationship_type
    FROM answers WHERE value IS NOT NULL
    UNION ALL SELECT t.value, 'AS' || CAST(x.asn AS VARCHAR), 'BELONGS_TO_ASN' FROM answers t JOIN (SELECT ip_int, asn FROM (SELECT i.ip_int, r.asn, r.hi FROM (SELECT DISTINCT ip_int FROM answers WHERE record_type = 'A') i JOIN asn_unique r ON r.lo <= i.ip_int
        QUALIFY row_number() OVER (PARTITION BY i.ip_int ORDER BY r.lo DESC) = 1) WHERE hi >= ip_int) x ON t.record_type = 'A' AND t.ip_int = x.ip_int""", {"answers": _ANSWERS, "asn_unique": ASN_UNIQUE})
def ob3b(spark, d):
    answers = table(spark, d, "lineitem").selectExpr(*map(spark_sql, _ANSWER))
    edges = dns.dns_plan(answers, cloud(spark, d), asns(spark, d)).edges
    return edges.select("source_id", "target_id", "relationship_type")


# --- crawl ---------------------------------------------------------------------------------------------------


def _crawl(spark, d):
    p = F.col("page_id")
    record = F.struct(
        F.struct(F.lit("GET").alias("method"), F.col("url").alias("endpoint"), F.when(p % 4 == 0, "https://x/app.js?v=1").otherwise("https://x/").alias("source"), F.when(p % 7 == 0, "JS").alias("tag")).alias("request"),
        F.struct("status_code").alias("response"),
    )
    return crawl.crawl_plan(_lines(spark, d, record, origin=F.lit("https://start")), rules_of(spark))


_OK_URLS = "SELECT DISTINCT regexp_replace(target, '#.*$', '') AS u FROM scope_decided WHERE program_id = 'P1' AND allowed"


@register("ob5_crawl", """
    SELECT 'j' || CAST(page_id % 5 AS VARCHAR) AS job_id, SHA(norm_url) AS url_hash, norm_url AS url, page_id % 4 = 0 OR page_id % 7 = 0 AS js_discovered, page_id AS seq FROM http_obs h JOIN ok_urls d ON h.norm_url = d.u WHERE page_id % 10 <> 9
    QUALIFY row_number() OVER (PARTITION BY page_id % 5, norm_url ORDER BY page_id) = 1""", {**_ctes(_URLS), "ok_urls": _OK_URLS})
def ob5(spark, d):
    return _crawl(spark, d).extra["urls"].select("job_id", "url_hash", "url", "js_discovered", "seq")


@register("ob5_crawl_blocked", """
    SELECT 'j' || CAST(page_id % 5 AS VARCHAR) AS job_id, page_id AS seq FROM http_obs h WHERE page_id % 10 <> 9 AND norm_url NOT IN (SELECT u FROM ok_urls)""", {**_ctes(_URLS), "ok_urls": _OK_URLS})
def ob5b(spark, d):
    return _crawl(spark, d).extra["blocked"].select("job_id", "seq")


# --- findings ------------------------------------------------------------------------------------------------


def _findings(spark, d):
    p = F.col("page_id")
    record = F.struct(
        F.concat(F.lit("t"), (p % 6).cast("string")).alias("template-id"), F.when(p % 11 != 0, F.col("url")).alias("matched-at"),
        F.struct(F.lit("n").alias("name"), F.when(p % 5 == 0, "Critical").when(p % 5 == 1, "low").alias("severity"),
                 F.struct(F.array(F.concat(F.lit("cve-2024-"), p.cast("string")), F.lit("x")).alias("cve-id")).alias("classification")).alias("info"),
    )
    return findings.findings_plan(_lines(spark, d, record, host=F.col("host")), rules_of(spark))


@register("ob7_findings", """
    SELECT 'j' || CAST(page_id % 5 AS VARCHAR) AS job_id, host, SHA('t' || CAST(page_id % 6 AS VARCHAR) || '|' || norm_url) AS finding_hash,
           CASE page_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'unknown' END AS severity, norm_url AS url
    FROM http_obs h JOIN ok_urls d ON h.norm_url = d.u WHERE page_id % 10 <> 9 AND page_id % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY host, page_id % 5, page_id % 6, norm_url ORDER BY page_id DESC) = 1""", {**_ctes(_URLS), "ok_urls": _OK_URLS})
def ob7(spark, d):
    return _findings(spark, d).extra["members"].select("job_id", "host", "finding_hash", "severity", "url")


@register("ob7_detected_cves", """
    SELECT host AS asset_id, 'CVE-2024-' || CAST(page_id AS VARCHAR) AS cve_id FROM http_obs h JOIN ok_urls d ON h.norm_url = d.u WHERE page_id % 10 <> 9 AND page_id % 11 <> 0""", {**_ctes(_URLS), "ok_urls": _OK_URLS})
def ob7b(spark, d):
    return _findings(spark, d).extra["correlations"].select("asset_id", "cve_id")


# --- discovery -----------------------------------------------------------------------------------------------

_HOST_TARGETS = "SELECT DISTINCT host AS target, host AS value, 'domain' AS kind, host, CAST(NULL AS VARCHAR) AS scheme, CAST(NULL AS VARCHAR) AS path FROM http_obs"


@register("ob8_search", f"""
    WITH t AS (SELECT page_id % 5 AS j, page_id, 1 AS pos, host AS target FROM http_obs WHERE page_id % 10 <> 9 UNION ALL SELECT page_id % 5, page_id, 0, {_IP.replace('STRING', 'VARCHAR')} FROM http_obs WHERE page_id % 10 <> 9 AND page_id % 3 <> 0),
         u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY j, target ORDER BY page_id, pos) = 1)
    SELECT 'j' || CAST(j AS VARCHAR) AS job_id, u.target, page_id AS seq, COALESCE(d.allowed, false) AS allowed FROM u LEFT JOIN scope_decided d ON u.target = d.target AND d.program_id = 'P1'""", _ctes(_HOST_TARGETS))
def ob8(spark, d):
    record = F.struct(F.lit("shodan").alias("source"), F.when(F.col("page_id") % 3 != 0, F.col("ip")).otherwise("not-ip").alias("ip"), F.upper("host").alias("host"), F.lit(443).alias("port"))
    rows = discovery.search_plan(_lines(spark, d, record, parent=F.lit("example.com")), rules_of(spark)).rows
    return rows.select("job_id", "target", "seq", "decision.allowed")


def _discovery(spark, d):
    p = F.col("page_id")
    kind = p % 6
    record = F.struct(
        F.when(kind == 0, "DNS_NAME").when(kind == 1, "ASN").when(kind == 2, "TECHNOLOGY").when(kind == 3, "OPEN_TCP_PORT").when(kind == 4, "SCAN").otherwise("URL").alias("type"),
        F.when(p % 12 == 6, "speculate").otherwise("crt").alias("module"), F.concat(F.lit("id"), p.cast("string")).alias("id"), F.concat(F.lit("id"), (p - 1).cast("string")).alias("parent"),
        F.upper("host").alias("host"), F.when(kind == 0, F.concat(F.upper("host"), F.lit("."))).when(kind == 3, F.concat("host", F.lit(":"), (8000 + p % 50).cast("string"))).alias("data"),
        F.struct(F.when(kind == 1, F.concat(F.lit("AS"), (64500 + p % 9).cast("string"))).alias("asn"), F.when(kind == 2, "cpe:/a:acme:web:1.2").alias("technology")).alias("data_json"),
    )
    lines = _lines(spark, d, record, parent_target=F.lit("example.com")).withColumn("job_id", F.lit("one"))
    return discovery.discovery_plan(lines, rules_of(spark))


_DISC = """
    SELECT h.page_id, h.host, h.page_id % 6 AS kind, COALESCE(d.allowed, false) AS allowed FROM http_obs h LEFT JOIN scope_decided d ON h.host = d.target AND d.program_id = 'P1'
    WHERE page_id % 10 <> 9 AND page_id % 6 <> 4 AND page_id % 12 <> 6"""


@register("ob9_discovery", """
    SELECT page_id AS seq, CASE kind WHEN 0 THEN 'DNS_NAME' WHEN 1 THEN 'ASN' WHEN 2 THEN 'TECHNOLOGY' WHEN 3 THEN 'OPEN_TCP_PORT' ELSE 'URL' END AS event_type, kind <> 1 AND allowed AS allowed FROM disc""", {**_ctes(_HOST_TARGETS), "disc": _DISC})
def ob9(spark, d):
    return _discovery(spark, d).rows.select("seq", "event_type", "decision.allowed")


@register("ob9_discovery_edges", """
    SELECT host AS source_id, 'example.com' AS target_id, 'DISCOVERED_FROM' AS relationship_type FROM disc WHERE kind = 0 AND allowed
    UNION ALL SELECT host, 'web', 'USES_TECHNOLOGY' FROM disc WHERE kind = 2 AND allowed
    UNION ALL SELECT p.host, 'AS' || CAST(64500 + c.page_id % 9 AS VARCHAR), 'BELONGS_TO_ASN' FROM disc c JOIN disc p ON p.page_id = c.page_id - 1 AND p.kind = 0 AND p.allowed WHERE c.kind = 1""", {**_ctes(_HOST_TARGETS), "disc": _DISC})
def ob9b(spark, d):
    return _discovery(spark, d).edges.select("source_id", "target_id", "relationship_type")


@register("ob9_discovery_ports", """
    SELECT host AS asset_id, string_agg(CAST(port AS VARCHAR), ',' ORDER BY port) AS ports FROM (SELECT DISTINCT host, 8000 + page_id % 50 AS port FROM disc WHERE kind = 3 AND allowed) GROUP BY host""", {**_ctes(_HOST_TARGETS), "disc": _DISC})
def ob9c(spark, d):
    return _discovery(spark, d).states.select("asset_id", F.array_join(F.col("ports").cast("array<string>"), ",").alias("ports"))


# --- certificate transparency --------------------------------------------------------------------------------


def certificates(spark, d):
    msgs = standin(spark, d, "http_obs").selectExpr("page_id AS seq", "ts AS observed_at", spark_sql(f"{CT_MESSAGE} AS value"))
    return parse_ct(msgs)


@register("ob10_ct_matches", """
    SELECT page_id AS seq, CASE WHEN page_id % 2 = 0 THEN SHA(url) ELSE 'sha1:ab' || CAST(page_id AS VARCHAR) END AS fingerprint, h.host AS domain, d.program_id, d.rule_id AS scope_id
    FROM http_obs h JOIN scope_decided d ON h.host = d.target AND d.allowed WHERE page_id % 7 <> 6""", _ctes(_HOST_TARGETS))
def ob10(spark, d):
    rows = ct_plans.ct_plan(certificates(spark, d), rules_of(spark)).rows
    return rows.select("seq", "fingerprint", "domain", "program_id", "scope_id")


@register("ob10_ct_out_of_scope", """
    SELECT page_id AS seq FROM http_obs h WHERE page_id % 7 <> 6 AND NOT EXISTS (SELECT 1 FROM scope_decided d WHERE h.host = d.target AND d.allowed)""", _ctes(_HOST_TARGETS))
def ob10b(spark, d):
    plan = ct_plans.ct_plan(certificates(spark, d), rules_of(spark), keep_out_of_scope=True)
    return plan.extra["out_of_scope"].select("seq")
