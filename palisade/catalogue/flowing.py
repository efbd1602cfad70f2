"""Whole flows of observation plans over two batches: what is stored and which events come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue.attributing import asns, cloud
from palisade.catalogue.observing import _HOST_TARGETS, _IP, _SAN_TARGETS, _SANS, HTTP_SETS, _lines, _now
from palisade.catalogue.registry import register
from palisade.catalogue.scoping import _ctes, rules_of
from palisade.catalogue.standins import NOW, NOW_US
from palisade.plans import crawl, discovery, findings, flow, http, tls
from palisade.plans.base import staged
from palisade.schemas import ASSETS, EVENTS, LINKS
from palisade.session import scratch_dir
from palisade.sources.commits import Store

#: Observations before this time are the first batch, the others the second.
_SPLIT_US = NOW_US - 2_592_000 * 1_000_000
_PARTS = (f"unix_micros(observed_at) < {_SPLIT_US}", f"unix_micros(observed_at) >= {_SPLIT_US}")


def _events(store):
    p = lambda path: F.get_json_object("payload", f"$.{path}")
    return store.events("events", EVENTS).select(
        "type", "index", "seq", p("asset.type").alias("asset_type"), p("asset.value").alias("asset_value"), p("program.id").alias("program_id"), p("change.field").alias("field"),
        F.coalesce(p("change.previous"), F.lit("")).alias("previous"), F.coalesce(p("change.current"), F.lit("")).alias("current"), F.coalesce(p("error.message"), p("scope_check.reason")).alias("message"))


def http_store(spark, d):
    """Pages in two batches through the HTTP flow."""
    store, rules = Store(spark, scratch_dir(spark, "http-flow"), buckets=8), rules_of(spark)
    tech = F.when(F.col("page_id") % 3 == 0, F.array(F.concat(F.lit("Nginx:1."), (F.col("page_id") % 7).cast("string")), F.lit("HSTS"))).when(
        F.col("page_id") % 3 == 1, F.array(F.lit("PHP:8.1")))
    record = F.struct(
        "url", "status_code", "webserver", "title", F.col("ip").alias("host_ip"), tech.alias("tech"), (F.col("page_id") % 8 == 7).alias("failed"))
    for number, part in enumerate(_PARTS):
        lines = staged("flow-lines")(_lines(spark, d, record).filter(part))
        found = http.http_plan(lines, rules, cloud(spark, d), asns(spark, d), stage=staged("http-rows"))
        flow.commit(found, lines, flow.http_flow(), store, number)
    return store


_FIRST = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY ts, page_id) = 1"
_HTTP_EVENTS = f"""
    SELECT 'RAW_OUTPUT' AS type, 'bb-httpx-raw' AS index, page_id AS seq, CAST(NULL AS VARCHAR) AS asset_type, CAST(NULL AS VARCHAR) AS asset_value, 'P1' AS program_id, CAST(NULL AS VARCHAR) AS field, '' AS previous, '' AS current, CAST(NULL AS VARCHAR) AS message FROM http_obs
    UNION ALL SELECT 'MALFORMED_SCANNER_OUTPUT', 'bb-errors', max(page_id), NULL, NULL, 'P1', NULL, '', '', CAST(count(*) AS VARCHAR) || ' malformed httpx lines' FROM http_obs WHERE page_id % 10 = 9 GROUP BY page_id % 5, EPOCH(ts) < {_SPLIT_US}
    UNION ALL SELECT 'SCOPE_BLOCKED', 'bb-changes', page_id, 'url', norm_url, 'P1', NULL, '', '', reason FROM http_decided WHERE NOT allowed
    UNION ALL SELECT 'HTTP_OBSERVATION', 'bb-http', page_id, 'url', norm_url, 'P1', NULL, '', '', NULL FROM http_ok
    UNION ALL SELECT 'ASSET_SNAPSHOT', 'bb-assets', page_id, 'url', norm_url, 'P1', NULL, '', '', NULL FROM http_ok
    UNION ALL (SELECT 'NEW_URL', 'bb-changes', page_id, 'url', norm_url, 'P1', 'url.full', '', norm_url, NULL FROM http_ok {_FIRST.format('norm_url')})
    UNION ALL (SELECT 'NEW_IP', 'bb-changes', page_id, 'url', norm_url, 'P1', 'host.ip', '', ip, NULL FROM http_ok {_FIRST.format('ip')})
    UNION ALL SELECT c.type, 'bb-changes', page_id, 'url', norm_url, 'P1', c.field, COALESCE(c.previous, ''), COALESCE(c.current, ''), NULL FROM (SELECT *, unnest(list_filter([
        {{'type': 'HTTP_STATUS_CHANGED', 'field': 'http.status_code', 'previous': CAST(p_status AS VARCHAR), 'current': CAST(status_code AS VARCHAR), 'is': p_status <> status_code}},
        {{'type': 'TITLE_CHANGED', 'field': 'http.title', 'previous': p_title, 'current': title, 'is': COALESCE(p_title, '') <> COALESCE(title, '')}},
        {{'type': 'TECHNOLOGY_CHANGED', 'field': 'http.webserver', 'previous': p_server, 'current': webserver, 'is': COALESCE(p_server, '') <> COALESCE(webserver, '')}},
        {{'type': 'IP_CHANGED', 'field': 'host.ip', 'previous': p_ip, 'current': ip, 'is': p_ip <> ip}},
        {{'type': 'ASN_CHANGED', 'field': 'asn.number', 'previous': CAST(p_asn AS VARCHAR), 'current': CAST(asn AS VARCHAR), 'is': COALESCE(p_asn <> asn, false)}},
        {{'type': 'CLOUD_PROVIDER_CHANGED', 'field': 'cloud.provider', 'previous': p_provider, 'current': provider, 'is': COALESCE(p_provider, '') <> COALESCE(provider, '')}}], lambda x: x."is")) AS c FROM http_pairs)
    UNION ALL SELECT 'TECHNOLOGY_ADDED', 'bb-changes', page_id, 'url', norm_url, 'P1', 'technology.name', '', unnest(list_filter(names, lambda x: NOT list_contains(p_names, x))), NULL FROM http_pairs
    UNION ALL SELECT 'TECHNOLOGY_REMOVED', 'bb-changes', page_id, 'url', norm_url, 'P1', 'technology.name', unnest(list_filter(p_names, lambda x: NOT list_contains(names, x))), '', NULL FROM http_pairs"""
_HTTP_FLOW = {
    **HTTP_SETS,
    "http_decided": """
        SELECT h.*, list_distinct(list_transform(string_split(h.techs, ','), lambda t: string_split(t, ':')[1])) AS names, COALESCE(d.allowed, false) AS allowed, COALESCE(d.reason, 'not in approved scope') AS reason, c.provider, a.asn FROM http_rows h
        LEFT JOIN scope_decided d ON h.norm_url = regexp_replace(d.target, '#.*$', '') AND d.program_id = 'P1' AND d.target = (SELECT min(url) FROM http_obs o WHERE o.norm_url = h.norm_url)
        LEFT JOIN page_cloud c ON h.page_id = c.page_id LEFT JOIN page_asn a ON h.page_id = a.page_id""",
    "http_ok": "SELECT * FROM http_decided WHERE allowed",
    "http_pairs": """
        SELECT * FROM (SELECT *, lag(status_code) OVER w AS p_status, lag(title) OVER w AS p_title, lag(webserver) OVER w AS p_server, lag(ip) OVER w AS p_ip, lag(asn) OVER w AS p_asn, lag(provider) OVER w AS p_provider, lag(list_filter(names, lambda x: x <> '')) OVER w AS p_names
        FROM (SELECT * REPLACE (list_filter(names, lambda x: x <> '') AS names) FROM http_ok) WINDOW w AS (PARTITION BY regexp_extract(norm_url, '^https?://[^/?]+') ORDER BY ts, page_id)) WHERE p_status IS NOT NULL""",
}


_STAGE = "CASE WHEN max_by(techs, (ts, page_id)) <> '' THEN 'TECH_IDENTIFIED' ELSE 'HTTP_PROBED' END"
_HTTP_ASSETS = f"""
    SELECT 'url' AS asset_type, norm_url AS asset_value, min(ts) AS first, max(ts) AS last, max(ts) AS scanned, 'active' AS status, {_STAGE} AS stage, 'in_scope' AS link FROM http_ok GROUP BY norm_url
    UNION ALL SELECT CASE WHEN length(host) - length(replace(host, '.', '')) = 1 THEN 'domain' ELSE 'subdomain' END, host, min(ts), max(ts), max(ts), 'active', {_STAGE}, NULL FROM http_ok GROUP BY host
    UNION ALL SELECT 'ipv4', ip, min(ts), max(ts), NULL, 'discovered', 'DISCOVERED', NULL FROM http_ok GROUP BY ip
    UNION ALL SELECT 'technology', name, min(ts), max(ts), NULL, 'discovered', 'DISCOVERED', NULL FROM (SELECT ts, unnest(names) AS name FROM http_ok) WHERE name <> '' GROUP BY name
    UNION ALL SELECT 'asn', 'AS' || CAST(asn AS VARCHAR), min(ts), max(ts), NULL, 'discovered', 'DISCOVERED', NULL FROM http_ok WHERE asn IS NOT NULL GROUP BY asn"""


@register("ob1_http_flow", f"""{_HTTP_EVENTS}
    UNION ALL SELECT 'asset', status, EPOCH(scanned), asset_type, asset_value, link, stage, CAST(EPOCH(first) AS VARCHAR), CAST(EPOCH(last) AS VARCHAR), NULL FROM http_assets""", {**_HTTP_FLOW, "http_assets": _HTTP_ASSETS})
def ob1_flow(spark, d):
    """All events, and the stored assets as rows of type ``asset`` (status, time of the scan, kind, value, link, stage, first and last seen)."""
    store = http_store(spark, d)
    links = store.table("links", LINKS).select(F.col("asset_id").alias("value"), F.lit("url").alias("asset_type"), F.col("status").alias("link"))
    us = lambda c: F.unix_micros(c)
    assets = store.table("assets", ASSETS).join(links, ["asset_type", "value"], "left").select(
        F.lit("asset").alias("type"), F.col("status").alias("index"), us("last_scanned").alias("seq"), "asset_type", F.col("value").alias("asset_value"), F.col("link").alias("program_id"),
        F.col("lifecycle_stage").alias("field"), us("first_seen").cast("string").alias("previous"), us("last_seen").cast("string").alias("current"), F.lit(None).cast("string").alias("message"))
    return _events(store).unionByName(assets)


@register("ob2_tls_flow", f"""
    SELECT 'RAW_OUTPUT' AS type, 'bb-tlsx-raw' AS index, page_id AS seq, CAST(NULL AS VARCHAR) AS asset_type, CAST(NULL AS VARCHAR) AS asset_value, 'P1' AS program_id, CAST(NULL AS VARCHAR) AS field, '' AS previous, '' AS current, CAST(NULL AS VARCHAR) AS message FROM http_obs
    UNION ALL SELECT 'MALFORMED_SCANNER_OUTPUT', 'bb-errors', max(page_id), NULL, NULL, 'P1', NULL, '', '', CAST(count(*) AS VARCHAR) || ' malformed tlsx lines' FROM http_obs WHERE page_id % 10 = 9 GROUP BY page_id % 5, EPOCH(ts) < {_SPLIT_US}
    UNION ALL SELECT 'SCOPE_BLOCKED', 'bb-changes', page_id, 'domain', host, 'P1', NULL, '', '', reason FROM tls_decided WHERE NOT allowed
    UNION ALL SELECT unnest(['TLS_OBSERVATION', 'ASSET_SNAPSHOT']), unnest(['bb-tls', 'bb-assets']), page_id, kind, host, 'P1', NULL, '', '', NULL FROM tls_ok
    UNION ALL (SELECT 'NEW_CERTIFICATE', 'bb-changes', page_id, kind, host, 'P1', 'tls.fingerprint', '', fp, NULL FROM tls_ok {_FIRST.format('fp')})
    UNION ALL (SELECT 'NEW_SUBDOMAIN', 'bb-changes', s.page_id, s.kind, s.host, 'P1', 'tls.san', '', san, NULL FROM (SELECT t.*, s.san, EPOCH(ts) < {_SPLIT_US} AS early FROM tls_ok t JOIN sans s USING (page_id)) s
        JOIN scope_decided x ON x.target = s.san AND x.program_id = 'P1' AND x.allowed
        WHERE NOT EXISTS (SELECT 1 FROM tls_ok o WHERE o.host = s.san AND (EPOCH(o.ts) < {_SPLIT_US} OR NOT s.early)) {_FIRST.format('san')})
    UNION ALL SELECT c.type, 'bb-changes', page_id, kind, host, 'P1', c.field, COALESCE(c.previous, ''), COALESCE(c.current, ''), NULL FROM (SELECT *, unnest(list_filter([
        {{'type': 'CERT_CHANGED', 'field': 'tls.fingerprint', 'previous': p_fp, 'current': fp, 'is': p_fp <> fp}}, {{'type': 'FINGERPRINT_CHANGED', 'field': 'tls.fingerprint', 'previous': p_fp, 'current': fp, 'is': p_fp <> fp}},
        {{'type': 'TLS_CHANGED', 'field': 'tls', 'previous': NULL, 'current': NULL, 'is': p_fp <> fp}},
        {{'type': CASE expiry WHEN 'expiring' THEN 'CERT_EXPIRING' ELSE 'CERTIFICATE_EXPIRED' END, 'field': 'tls.not_after', 'previous': p_expiry, 'current': not_after, 'is': expiry <> 'valid' AND expiry IS DISTINCT FROM p_expiry}}],
        lambda x: COALESCE(x."is", false))) AS c FROM (SELECT *, lag(fp) OVER w AS p_fp, lag(expiry) OVER w AS p_expiry FROM tls_ok WINDOW w AS (PARTITION BY host ORDER BY ts, page_id)))""", {
    "sans": _SANS, **_ctes(_SAN_TARGETS),
    "tls_decided": f"""
        SELECT h.*, 'fp' || CAST(h.page_id % 50 AS VARCHAR) AS fp, CASE WHEN page_id * 13 % 120 - 40 < 0 THEN 'expired' WHEN page_id * 13 % 120 - 40 <= 30 THEN 'expiring' ELSE 'valid' END AS expiry,
            strftime(TIMESTAMP '{NOW}' + to_days(CAST(page_id * 13 % 120 - 40 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS not_after, COALESCE(d.allowed, false) AS allowed, COALESCE(d.reason, 'not in approved scope') AS reason,
            CASE WHEN length(h.host) - length(replace(h.host, '.', '')) = 1 THEN 'domain' ELSE 'subdomain' END AS kind
        FROM http_obs h LEFT JOIN scope_decided d ON h.host = d.target AND d.program_id = 'P1' WHERE page_id % 10 <> 9 AND page_id % 6 <> 5""",
    "tls_ok": "SELECT * FROM tls_decided WHERE allowed",
})
def ob2_flow(spark, d):
    store, rules = Store(spark, scratch_dir(spark, "tls-flow"), buckets=8), rules_of(spark)
    p = F.col("page_id")
    not_after = F.date_format(F.expr(f"TIMESTAMP '{NOW}' + make_dt_interval(CAST(page_id * 13 % 120 - 40 AS INT))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.struct(
        F.when(p % 6 != 5, F.struct(F.concat(F.lit("fp"), (p % 50).cast("string")).alias("sha256"))).alias("fingerprint_hash"), F.lit("443").alias("port"), F.expr(_IP).alias("ip"),
        F.array(F.col("host"), F.concat(F.lit("WWW."), F.upper("host")), F.lit("other.example.org"), F.lit("bad..name")).alias("subject_an"), not_after.alias("not_after"))
    for number, part in enumerate(_PARTS):
        lines = staged("flow-lines")(_lines(spark, d, record, host=F.col("host")).filter(part))
        flow.commit(tls.tls_plan(lines, rules, _now(), stage=staged("tls-rows")), lines, flow.tls_flow(), store, number)
    return _events(store)


_CRAWLED = "CONCAT('https://', host, '/p', CAST(page_id % 6 AS STRING))"
_CRAWL_TARGETS = f"SELECT DISTINCT {_CRAWLED.replace('STRING', 'VARCHAR')} AS target, {_CRAWLED.replace('STRING', 'VARCHAR')} AS value, 'url' AS kind, host, 'https' AS scheme, '/p' || CAST(page_id % 6 AS VARCHAR) AS path FROM http_obs"
_RUN_SETS = {
    **_ctes(_CRAWL_TARGETS),
    "run_lines": f"""
        SELECT h.*, {_CRAWLED.replace('STRING', 'VARCHAR')} AS u, CASE WHEN EPOCH(ts) < {_SPLIT_US} THEN '0' ELSE '1' END || '|j' || CAST(page_id % 5 AS VARCHAR) AS run,
            CASE WHEN length(host) - length(replace(host, '.', '')) = 1 THEN 'domain' ELSE 'subdomain' END AS kind FROM http_obs h""",
    "run_rows": "SELECT r.*, COALESCE(d.allowed, false) AS allowed, COALESCE(d.reason, 'not in approved scope') AS reason FROM run_lines r LEFT JOIN scope_decided d ON d.target = r.u AND d.program_id = 'P1' WHERE page_id % 10 <> 9",
    "run_list": "SELECT host, kind, run, max(page_id) AS page_id, lag(run) OVER (PARTITION BY host ORDER BY run) AS prev_run FROM run_lines GROUP BY host, kind, run",
}


def _run_events(tool: str, members: str) -> str:
    return f"""
    SELECT 'RAW_OUTPUT' AS type, 'bb-{tool}-raw' AS index, page_id AS seq, CAST(NULL AS VARCHAR) AS asset_type, CAST(NULL AS VARCHAR) AS asset_value, 'P1' AS program_id, CAST(NULL AS VARCHAR) AS field, '' AS previous, '' AS current, CAST(NULL AS VARCHAR) AS message FROM run_lines
    UNION ALL SELECT 'MALFORMED_SCANNER_OUTPUT', 'bb-errors', max(page_id), NULL, NULL, 'P1', NULL, '', '', CAST(count(*) AS VARCHAR) || ' malformed {tool} lines' FROM run_lines WHERE page_id % 10 = 9 GROUP BY run
    UNION ALL SELECT 'SCOPE_BLOCKED', 'bb-changes', page_id, 'url', u, 'P1', NULL, '', '', reason FROM run_rows WHERE NOT allowed
    UNION ALL SELECT 'ASSET_SNAPSHOT', 'bb-assets', page_id, kind, host, 'P1', NULL, '', '', NULL FROM run_list
    {members}"""


def _run_store(spark, d, name, record, make, flow_of, **extra):
    store, rules = Store(spark, scratch_dir(spark, name), buckets=8), rules_of(spark)
    for number, part in enumerate(_PARTS):
        lines = staged("flow-lines")(_lines(spark, d, record, **extra).filter(part))
        found = make(lines, rules, stage=staged(name))
        flow.commit(found, lines, flow_of(found), store, number)
    return store


@register("ob5_crawl_flow", _run_events("katana", """
    UNION ALL (SELECT unnest(['CRAWLED_URL', 'URL_INVENTORY']), unnest(['bb-katana', 'bb-urls']), page_id, 'url', u, 'P1', NULL, '', '', NULL FROM run_rows WHERE allowed QUALIFY row_number() OVER (PARTITION BY run, u ORDER BY page_id) = 1)
    UNION ALL SELECT 'NEW_ENDPOINT', 'bb-changes', l.page_id, l.kind, l.host, 'P1', 'url.path', '', m.u, NULL FROM run_list l JOIN (SELECT DISTINCT host, run, u FROM run_rows WHERE allowed) m ON l.host = m.host AND l.run = m.run
        WHERE prev_run IS NOT NULL AND NOT EXISTS (SELECT 1 FROM run_rows b WHERE b.allowed AND b.host = l.host AND b.run = l.prev_run AND b.u = m.u)"""), _RUN_SETS)
def ob5_flow(spark, d):
    record = F.struct(F.struct(F.lit("GET").alias("method"), F.expr(_CRAWLED).alias("endpoint"), F.lit("https://x/").alias("source")).alias("request"), F.struct("status_code").alias("response"))
    return _events(_run_store(spark, d, "crawl-flow", record, crawl.crawl_plan, flow.crawl_flow, origin=F.concat(F.lit("https://"), "host")))


@register("ob7_findings_flow", _run_events("nuclei", """
    UNION ALL SELECT 'VULNERABILITY_DETECTED', 'bb-nuclei', page_id, 'url', u, 'P1', NULL, '', '', NULL FROM run_rows WHERE allowed
    UNION ALL SELECT c, 'bb-changes', l.page_id, l.kind, l.host, 'P1', 'vuln.finding', '', m.label, NULL FROM run_list l JOIN run_members m ON l.host = m.host AND l.run = m.run, unnest(['NEW_FINDING', 'NEW_CRITICAL_FINDING']) n(c)
        WHERE prev_run IS NOT NULL AND (c = 'NEW_FINDING' OR m.severity = 'critical') AND NOT EXISTS (SELECT 1 FROM run_members b WHERE b.host = l.host AND b.run = l.prev_run AND b.u = m.u AND b.t = m.t)
    UNION ALL SELECT 'FINDING_RESOLVED', 'bb-changes', l.page_id, l.kind, l.host, 'P1', 'vuln.finding', m.label, '', NULL FROM run_list l JOIN run_members m ON l.host = m.host AND l.prev_run = m.run
        WHERE NOT EXISTS (SELECT 1 FROM run_members b WHERE b.host = l.host AND b.run = l.run AND b.u = m.u AND b.t = m.t)"""), {
    **_RUN_SETS,
    "run_members": """
        SELECT host, run, u, t, severity, t || ' @ ' || u || ' (' || severity || ')' AS label FROM (
            SELECT *, 't' || CAST(page_id % 2 AS VARCHAR) AS t, CASE page_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'unknown' END AS severity FROM run_rows WHERE allowed)
        QUALIFY row_number() OVER (PARTITION BY host, run, u, t ORDER BY page_id DESC) = 1"""})
def ob7_flow(spark, d):
    p = F.col("page_id")
    record = F.struct(
        F.concat(F.lit("t"), (p % 2).cast("string")).alias("template-id"), F.expr(_CRAWLED).alias("matched-at"),
        F.struct(F.lit("n").alias("name"), F.when(p % 5 == 0, "Critical").when(p % 5 == 1, "low").alias("severity")).alias("info"))
    return _events(_run_store(spark, d, "findings-flow", record, findings.findings_plan, flow.findings_flow, host=F.col("host")))


@register("ob8_search_flow", f"""
    WITH t AS (SELECT *, page_id % 5 AS j, EPOCH(ts) < {_SPLIT_US} AS early FROM http_obs WHERE page_id % 10 <> 9), u AS (SELECT t.*, COALESCE(d.allowed, false) AS allowed, COALESCE(d.reason, 'not in approved scope') AS reason FROM t LEFT JOIN scope_decided d ON t.host = d.target AND d.program_id = 'P1'
            QUALIFY row_number() OVER (PARTITION BY j, early, t.host ORDER BY page_id) = 1),
        k AS (SELECT *, CASE WHEN length(host) - length(replace(host, '.', '')) = 1 THEN 'domain' ELSE 'subdomain' END AS kind FROM u)
    SELECT 'RAW_OUTPUT' AS type, 'bb-uncover-raw' AS index, page_id AS seq, CAST(NULL AS VARCHAR) AS asset_type, CAST(NULL AS VARCHAR) AS asset_value, 'P1' AS program_id, CAST(NULL AS VARCHAR) AS field, '' AS previous, '' AS current, CAST(NULL AS VARCHAR) AS message FROM http_obs
    UNION ALL SELECT 'MALFORMED_SCANNER_OUTPUT', 'bb-errors', max(page_id), NULL, NULL, 'P1', NULL, '', '', CAST(count(*) AS VARCHAR) || ' malformed uncover lines' FROM http_obs WHERE page_id % 10 = 9 GROUP BY page_id % 5, EPOCH(ts) < {_SPLIT_US}
    UNION ALL SELECT 'UNCOVER_RESULT', 'bb-uncover', page_id, kind, host, 'P1', NULL, '', '', reason FROM k
    UNION ALL (SELECT 'NEW_SUBDOMAIN', 'bb-changes', page_id, kind, host, 'P1', 'uncover', '', host, NULL FROM k WHERE allowed {_FIRST.format('host').replace('ORDER BY ts', 'ORDER BY NOT early, ts')})""", _ctes(_HOST_TARGETS))
def ob8_flow(spark, d):
    record = F.struct(F.lit("shodan").alias("source"), F.lit("not-ip").alias("ip"), F.upper("host").alias("host"), F.lit(443).alias("port"))
    return _events(_run_store(spark, d, "search-flow", record, discovery.search_plan, lambda _: flow.search_flow(), parent=F.lit("example.com")))
