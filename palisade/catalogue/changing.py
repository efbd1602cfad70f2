"""Change detection over successive states."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue.registry import register
from palisade.catalogue.merging import CORRELATED, correlations
from palisade.catalogue.scoping import _ctes, _URLS, rules_of
from palisade.catalogue.standins import NOW, standin
from palisade.operators import changes, merge
from palisade.operators.scope import with_decision
from palisade.operators.skew import with_previous
from palisade.plans.base import pair_states
from palisade.sources.events import build_event


@register("wn3_previous_state", """
    SELECT asset_id, seq, lag(ip) OVER w AS previous_ip, lag(asn) OVER w AS previous_asn FROM facet_obs WINDOW w AS (PARTITION BY asset_id ORDER BY us, seq)""")
def wn3(spark, d):
    obs = standin(spark, d, "facet_obs")
    hour = F.floor(F.col("us") / F.lit(3_600_000_000))
    out = with_previous(obs, ["asset_id"], ["us", "seq"], ["ip", "asn"], hour)
    return out.select("asset_id", "seq", F.col("previous.ip").alias("previous_ip"), F.col("previous.asn").alias("previous_asn"))


def _paired(spark, d, facet: str, state):
    obs = standin(spark, d, "facet_obs").select(
        "asset_id", F.lit(facet).alias("facet"), F.timestamp_micros("us").alias("observed_at"), "seq", state.alias("current")
    )
    return pair_states(obs)


_LAG = "SELECT *, lag(k) OVER (PARTITION BY asset_id ORDER BY us, seq) AS pk, lag(seq) OVER (PARTITION BY asset_id ORDER BY us, seq) AS pseq FROM facet_obs"


def _rows(*branches: tuple[str, str, str, str, str]) -> str:
    """UNION ALL of (condition, change_type, field, previous, current) branches over ``pairs``."""
    return " UNION ALL ".join(
        f"SELECT asset_id, seq, '{kind}' AS change_type, '{field}' AS field, {prev} AS previous, {cur} AS current FROM pairs WHERE {cond}" for cond, kind, field, prev, cur in branches
    )


_KEEP = ["asset_id", "seq", "change_type", "field", "previous", "current"]
_A = lambda k: f"'[192.0.2.' || CAST({k} % 8 AS VARCHAR) || ']'"
_NS = lambda k: f"CASE WHEN {k} % 5 = 0 THEN '[]' ELSE '[ns' || CAST({k} % 2 AS VARCHAR) || '.example.net]' END"
_STATE = lambda k: (  # noqa: E731  (the summary carries whole states)
    f"""'{{"a":["192.0.2.' || CAST({k} % 8 AS VARCHAR) || '"],"aaaa":[],"cname":[],"mx":[],"ns":[' || CASE WHEN {k} % 5 = 0 THEN '' ELSE '"ns' || CAST({k} % 2 AS VARCHAR) || '.example.net"' END
    || '],"txt":[],"asn":[' || CASE WHEN {k} % 3 = 0 THEN '' ELSE '"' || CAST(64500 + {k} % 3 AS VARCHAR) || '"' END || '],"cloud":[],"has_asn":' || CASE WHEN {k} % 4 <> 0 THEN 'true' ELSE 'false' END || ',"has_cloud":true}}'"""
)
_DNS_HIT = "pk IS NOT NULL AND (k % 8 <> pk % 8 OR " + f"{_NS('k')} <> {_NS('pk')})"


@register("chg1_dns", _rows(
    ("pk IS NOT NULL AND k % 8 <> pk % 8", "A_CHANGED", "dns.a", _A("pk"), _A("k")),
    (f"pk IS NOT NULL AND {_NS('k')} <> {_NS('pk')}", "NS_CHANGED", "dns.ns", _NS("pk"), _NS("k")),
    (_DNS_HIT, "DNS_CHANGED", "dns", _STATE("pk"), _STATE("k")),
    ("pk IS NOT NULL AND pk % 4 <> 0 AND pk % 3 <> 0 AND k % 3 <> 0 AND k % 3 <> pk % 3", "ASN_CHANGED", "asn.number", "'[' || CAST(64500 + pk % 3 AS VARCHAR) || ']'", "'[' || CAST(64500 + k % 3 AS VARCHAR) || ']'"),
    ("pk IS NOT NULL AND k % 8 <> pk % 8", "IP_CHANGED", "dns.ips", _A("pk"), _A("k")),
), {"pairs": _LAG})
def chg1(spark, d):
    k = F.col("k")
    text = lambda s, n: F.concat(F.lit(s), (k % n).cast("string"))
    empty = F.array().cast("array<string>")
    state = F.struct(
        F.array(text("192.0.2.", 8)).alias("a"), empty.alias("aaaa"), empty.alias("cname"), empty.alias("mx"),
        F.when(k % 5 == 0, empty).otherwise(F.array(F.concat(text("ns", 2), F.lit(".example.net")))).alias("ns"), empty.alias("txt"),
        F.when(k % 3 == 0, empty).otherwise(F.array((64500 + k % 3).cast("string"))).alias("asn"), empty.alias("cloud"), (k % 4 != 0).alias("has_asn"), F.lit(True).alias("has_cloud"),
    )
    return changes.diff_dns(_paired(spark, d, "dns", state), ["asset_id", "seq"]).select(*_KEEP)


_T = lambda k: f"CASE {k} % 4 WHEN 0 THEN '' WHEN 1 THEN 'home' WHEN 2 THEN 'login' END"
_BLANK_T = lambda k: f"COALESCE({_T(k)}, '')"


@register("chg2_http", _rows(
    ("pk IS NOT NULL AND k % 5 <> pk % 5", "HTTP_STATUS_CHANGED", "http.status_code", "CAST(200 + pk % 5 AS VARCHAR)", "CAST(200 + k % 5 AS VARCHAR)"),
    (f"pk IS NOT NULL AND {_BLANK_T('k')} <> {_BLANK_T('pk')}", "TITLE_CHANGED", "http.title", _T("pk"), _T("k")),
    ("pk IS NOT NULL AND k % 2 <> pk % 2", "TECHNOLOGY_CHANGED", "http.webserver", "CASE WHEN pk % 2 = 0 THEN 'nginx' END", "CASE WHEN k % 2 = 0 THEN 'nginx' END"),
    ("pk IS NOT NULL AND k % 6 <> pk % 6", "TECHNOLOGY_ADDED", "technology.name", "CAST(NULL AS VARCHAR)", "'t' || CAST(k % 6 AS VARCHAR)"),
    ("pk IS NOT NULL AND k % 6 <> pk % 6", "TECHNOLOGY_REMOVED", "technology.name", "'t' || CAST(pk % 6 AS VARCHAR)", "CAST(NULL AS VARCHAR)"),
    ("pk IS NOT NULL AND k % 9 <> 0 AND pk % 9 <> 0 AND k % 8 <> pk % 8", "IP_CHANGED", "host.ip", "'192.0.2.' || CAST(pk % 8 AS VARCHAR)", "'192.0.2.' || CAST(k % 8 AS VARCHAR)"),
    ("pk IS NOT NULL AND k % 7 % 2 <> pk % 7 % 2", "CLOUD_PROVIDER_CHANGED", "http.cdn", "CASE WHEN pk % 7 % 2 = 1 THEN 'cloudflare' ELSE '' END", "CASE WHEN k % 7 % 2 = 1 THEN 'cloudflare' ELSE '' END"),
    ("pk IS NOT NULL AND pk % 4 <> 0 AND k % 3 <> pk % 3", "ASN_CHANGED", "asn.number", "CAST(64500 + pk % 3 AS VARCHAR)", "CAST(64500 + k % 3 AS VARCHAR)"),
    ("pk IS NOT NULL AND pk % 4 <> 1 AND k % 10 <> pk % 10", "CLOUD_PROVIDER_CHANGED", "cloud.provider", "CASE WHEN pk % 10 > 0 THEN 'c' || CAST(pk % 10 AS VARCHAR) END", "CASE WHEN k % 10 > 0 THEN 'c' || CAST(k % 10 AS VARCHAR) END"),
), {"pairs": _LAG})
def chg2(spark, d):
    k = F.col("k")
    text = lambda s, n: F.concat(F.lit(s), (k % n).cast("string"))
    state = F.struct(
        (200 + k % 5).alias("status_code"), F.when(k % 4 == 0, "").when(k % 4 == 1, "home").when(k % 4 == 2, "login").alias("title"),
        F.when(k % 2 == 0, "nginx").alias("webserver"), F.array(F.lit("base"), text("t", 6)).alias("technologies"), F.when(k % 9 != 0, text("192.0.2.", 8)).alias("ip"),
        F.when(k % 7 % 2 == 1, "cloudflare").otherwise("").alias("cdn"), F.col("asn").alias("asn"), F.when(k % 10 > 0, text("c", 10)).alias("cloud"),
        (k % 4 != 0).alias("has_asn"), (k % 4 != 1).alias("has_cloud"),
    )
    return changes.diff_http(_paired(spark, d, "http", state), ["asset_id", "seq"]).select(*_KEEP)


_EX = lambda k: f"CASE {k} % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'expiring' ELSE 'expired' END"
_SAN = lambda k: f"'[a.example.com, s' || CAST({k} % 6 AS VARCHAR) || '.example.com]'"
_TLS_ANY = "pk IS NOT NULL AND (k % 10 <> pk % 10 OR k % 4 <> pk % 4 OR k % 6 <> pk % 6 OR k % 2 <> pk % 2)"


@register("chg3_tls", _rows(
    ("k % 3 = 1 AND (pk IS NULL OR pk % 3 <> 1)", "CERT_EXPIRING", "tls.not_after", f"CASE WHEN pk IS NOT NULL THEN {_EX('pk')} END", "'d' || CAST(k AS VARCHAR)"),
    ("k % 3 = 2 AND (pk IS NULL OR pk % 3 <> 2)", "CERTIFICATE_EXPIRED", "tls.not_after", f"CASE WHEN pk IS NOT NULL THEN {_EX('pk')} END", "'d' || CAST(k AS VARCHAR)"),
    ("pk IS NOT NULL AND k % 10 <> pk % 10", "CERT_CHANGED", "tls.fingerprint", "'fp' || CAST(pk % 10 AS VARCHAR)", "'fp' || CAST(k % 10 AS VARCHAR)"),
    ("pk IS NOT NULL AND k % 10 <> pk % 10", "FINGERPRINT_CHANGED", "tls.fingerprint", "'fp' || CAST(pk % 10 AS VARCHAR)", "'fp' || CAST(k % 10 AS VARCHAR)"),
    ("pk IS NOT NULL AND k % 4 <> pk % 4", "ISSUER_CHANGED", "tls.issuer", "'i' || CAST(pk % 4 AS VARCHAR)", "'i' || CAST(k % 4 AS VARCHAR)"),
    ("pk IS NOT NULL AND k % 6 <> pk % 6", "SAN_CHANGED", "tls.san", _SAN("pk"), _SAN("k")),
    ("pk IS NOT NULL AND k % 2 <> pk % 2", "TLS_VERSION_CHANGED", "tls.version", "'tls1' || CAST(2 + pk % 2 AS VARCHAR)", "'tls1' || CAST(2 + k % 2 AS VARCHAR)"),
    (_TLS_ANY, "TLS_CHANGED", "tls", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"),
), {"pairs": _LAG})
def chg3(spark, d):
    k = F.col("k")
    text = lambda s, n: F.concat(F.lit(s), (k % n).cast("string"))
    state = F.struct(
        text("fp", 10).alias("fingerprint"), text("i", 4).alias("issuer"), F.array(F.concat(text("s", 6), F.lit(".example.com")), F.lit("a.example.com")).alias("san"),
        F.concat(F.lit("tls1"), (2 + k % 2).cast("string")).alias("tls_version"), F.concat(F.lit("d"), k.cast("string")).alias("not_after"),
        F.when(k % 3 == 0, "valid").when(k % 3 == 1, "expiring").otherwise("expired").alias("expiry_status"),
    )
    return changes.diff_tls(_paired(spark, d, "tls:443", state), ["asset_id", "seq"]).select(*_KEEP)


@register("chg4_ports", """
    SELECT asset_id, seq, 'NEW_PORT' AS change_type, CAST(NULL AS VARCHAR) AS previous, CAST(p AS VARCHAR) AS current FROM (SELECT asset_id, seq, unnest(cur) AS p, prev FROM port_pairs) WHERE NOT list_contains(prev, p)
    UNION ALL SELECT asset_id, seq, 'PORT_REMOVED', CAST(p AS VARCHAR), NULL FROM (SELECT asset_id, seq, unnest(prev) AS p, cur FROM port_pairs) WHERE NOT list_contains(cur, p)""",
          {"pairs": _LAG, "port_pairs": "SELECT asset_id, seq, list_distinct([80 + k % 3, 443 + k % 4, 8000 + k % 5]) AS cur, list_distinct([80 + pk % 3, 443 + pk % 4, 8000 + pk % 5]) AS prev FROM pairs WHERE pk IS NOT NULL"})
def chg4(spark, d):
    k = F.col("k")
    state = F.struct(F.array(80 + k % 3, 443 + k % 4, 8000 + k % 5).alias("ports"))
    out = changes.diff_ports(_paired(spark, d, "ports:bbot", state), ["asset_id", "seq"])
    return out.select("asset_id", "seq", "change_type", "previous", "current")


# runs of set-valued facets: a user's day is a run; k of its errors and purchases are the members, so many runs find nothing
_MEMBERS = """
    SELECT DISTINCT f.asset_id, CAST(floor(us / 86400000000) AS BIGINT) AS run, SHA(CAST(k % 25 AS VARCHAR)) AS h, k % 25 AS m FROM facet_obs f WHERE status_code IN (500, 302)"""
_RUNS = "SELECT asset_id, run, lag(run) OVER (PARTITION BY asset_id ORDER BY run) AS prev_run FROM (SELECT DISTINCT asset_id, CAST(floor(us / 86400000000) AS BIGINT) AS run FROM facet_obs)"
_SETS = {"members": _MEMBERS, "runs": _RUNS}


def _runs(spark, d, owner):
    return standin(spark, d, "facet_obs").select(owner, F.floor(F.col("us") / F.lit(86_400_000_000)).alias("run"))


def _members(spark, d):
    from palisade.functions.common import sha256

    obs = standin(spark, d, "facet_obs").filter("status_code IN (500, 302)")
    return obs.select("asset_id", F.floor(F.col("us") / F.lit(86_400_000_000)).alias("run"), (F.col("k") % 25).alias("m")).distinct().withColumn("h", sha256(F.col("m").cast("string")))


@register("chg5_endpoints", """
    SELECT m.asset_id AS origin, m.run, '/e' || CAST(m.m AS VARCHAR) AS endpoint FROM members m JOIN runs r ON m.asset_id = r.asset_id AND m.run = r.run AND r.prev_run IS NOT NULL
    WHERE NOT EXISTS (SELECT 1 FROM members s WHERE s.asset_id = m.asset_id AND s.run = r.prev_run AND s.h = m.h)""", _SETS)
def chg5(spark, d):
    members = _members(spark, d).select(
        F.col("asset_id").cast("string").alias("origin"), "run", F.col("h").alias("endpoint_hash"), F.concat(F.lit("/e"), F.col("m").cast("string")).alias("endpoint")
    )
    out = changes.diff_endpoints(members, runs=_runs(spark, d, F.col("asset_id").cast("string").alias("origin")))
    return out.select(F.col("origin").cast("bigint").alias("origin"), "run", F.expr("substring(current, length(origin) + 1)").alias("endpoint"))


_SEV = "CASE WHEN m % 4 = 0 THEN 'critical' ELSE 'low' END"


@register("chg6_findings", f"""
    WITH fresh AS (SELECT m.* FROM members m JOIN runs r ON m.asset_id = r.asset_id AND m.run = r.run AND r.prev_run IS NOT NULL
            WHERE NOT EXISTS (SELECT 1 FROM members s WHERE s.asset_id = m.asset_id AND s.run = r.prev_run AND s.h = m.h)),
         gone AS (SELECT s.asset_id, r.run, s.h, s.m FROM members s JOIN runs r ON s.asset_id = r.asset_id AND s.run = r.prev_run
            WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.asset_id = r.asset_id AND m.run = r.run AND m.h = s.h))
    SELECT asset_id AS host, run, 'NEW_FINDING' AS change_type, CAST(NULL AS VARCHAR) AS previous, 't' || CAST(m AS VARCHAR) || ' @ u (' || {_SEV} || ')' AS current FROM fresh
    UNION ALL SELECT asset_id, run, 'NEW_CRITICAL_FINDING', NULL, 't' || CAST(m AS VARCHAR) || ' @ u (critical)' FROM fresh WHERE m % 4 = 0
    UNION ALL SELECT asset_id, run, 'FINDING_RESOLVED', 't' || CAST(m AS VARCHAR) || ' @ u (' || {_SEV} || ')', NULL FROM gone""", _SETS)
def chg6(spark, d):
    members = _members(spark, d).select(
        F.col("asset_id").alias("host"), "run", F.col("h").alias("finding_hash"), F.when(F.col("m") % 4 == 0, "critical").otherwise("low").alias("severity"),
        F.concat(F.lit("t"), F.col("m").cast("string")).alias("template_id"), F.lit("u").alias("url"),
    )
    return changes.diff_findings(members, runs=_runs(spark, d, F.col("asset_id").alias("host"))).select("host", "run", "change_type", "previous", "current")


@register("chg7_new_assets", """
    SELECT value, CASE asset_type WHEN 'domain' THEN 'NEW_DOMAIN' WHEN 'subdomain' THEN 'NEW_SUBDOMAIN' WHEN 'ipv4' THEN 'NEW_IP' WHEN 'url' THEN 'NEW_URL' WHEN 'certificate' THEN 'NEW_CERTIFICATE' ELSE 'NEW_ASSET' END AS change_type
    FROM (SELECT DISTINCT asset_type, value FROM assets) a WHERE NOT EXISTS (SELECT 1 FROM assets c WHERE c.asset_id % 3 = 0 AND c.asset_type = a.asset_type AND c.value = a.value)""")
def chg7(spark, d):
    a = standin(spark, d, "assets")
    cur = a.filter("asset_id % 3 = 0").select("asset_type", "value").distinct().selectExpr(
        "asset_type", "value", "'active' AS status", "'DISCOVERED' AS lifecycle_stage", "timestamp_micros(0) AS first_seen", "timestamp_micros(0) AS last_seen",
        "CAST(1 AS DOUBLE) AS confidence_score", "'m' AS confidence_source", "'m' AS confidence_reason",
    )
    obs = a.selectExpr("asset_type", "value", "last_seen AS seen_at", "CAST(0.5 AS DOUBLE) AS confidence", "'x' AS source", "'x' AS reason", "asset_id AS seq")
    return merge.changed_assets(merge.upsert_assets(cur, obs)).select("value", "change_type")


@register("chg8_vulnerability_changes", """
    SELECT c.cve_id, c.asset_id, l.program_id, t.change_type FROM correlated c LEFT JOIN (SELECT DISTINCT asset_id, program_id FROM links WHERE status = 'in_scope') l ON c.asset_id = l.asset_id
    JOIN (VALUES ('NEW_CVE'), ('KEV_ADDED')) AS t(change_type) ON (t.change_type = 'NEW_CVE' AND c.inserted) OR (t.change_type = 'KEV_ADDED' AND c.in_kev AND NOT c.was_kev)""", {"correlated": CORRELATED})
def chg8(spark, d):
    cur, new = correlations(spark, d)
    merged = merge.upsert_correlations(cur, new, standin(spark, d, "kev_prev").filter("removed_at IS NULL"))
    programs = standin(spark, d, "links").filter("status = 'in_scope'").select("asset_id", "program_id").distinct()
    return changes.vulnerability_changes(merged, programs).select("cve_id", "asset_id", "program_id", "change_type")


@register("chg9_change_events", """
    SELECT seq, 'IP_CHANGED' AS type, '192.0.2.' || CAST(pk % 8 AS VARCHAR) AS previous, '192.0.2.' || CAST(k % 8 AS VARCHAR) AS current, '0.95' AS score FROM pairs WHERE pk IS NOT NULL AND k % 8 <> pk % 8""", {"pairs": _LAG})
def chg9(spark, d):
    state = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("status_code", "int"), ("title", "string"), ("webserver", "string"), ("technologies", "array<string>"))],
                     F.col("ip"), *[F.lit(None).cast(t).alias(n) for n, t in (("cdn", "string"), ("asn", "bigint"), ("cloud", "string"), ("has_asn", "boolean"), ("has_cloud", "boolean"))])
    rows = changes.diff_http(_paired(spark, d, "http", state), ["asset_id", "seq"])
    c = F.col
    ev = build_event(
        rows, index="bb-changes", kind="event", category="change", type_=c("change_type"), ts=F.lit(NOW).cast("timestamp"),
        context={"asset": {"id": c("asset_id").cast("string")}, "source": {"name": F.lit("httpx")}},
        body={"change": {"type": c("change_type"), "field": c("field"), "previous": c("previous"), "current": c("current")}, "confidence": {"score": F.lit(0.95), "source": F.lit("httpx")}},
        keep=["seq"],
    )
    at = lambda p: F.get_json_object("payload", p)
    return ev.select("seq", "type", at("$.change.previous").alias("previous"), at("$.change.current").alias("current"), at("$.confidence.score").alias("score"))


@register("chg10_scope_blocked", """
    SELECT page_id, 'scanner_output' AS layer, COALESCE(d.reason, 'not in approved scope') AS reason, CASE WHEN d.match_kind = 'explicit_exclusion' THEN 'excluded' ELSE 'out' END AS scope_status
    FROM http_obs h LEFT JOIN scope_decided d ON h.url = d.target AND d.program_id = 'P1' WHERE NOT COALESCE(d.allowed, false)""", _ctes(_URLS))
def chg10(spark, d):
    obs = standin(spark, d, "http_obs").select("page_id", "url", F.lit("P1").alias("program_id"))
    checked = with_decision(obs, rules_of(spark), "url", "program_id")
    return changes.scope_blocked(checked, "scanner_output", ["page_id"]).select("page_id", "layer", "reason", "scope_status")


@register("chg11_snapshots", """SELECT seq, asset_id, '{"http":{"ip":"' || ip || '","asn":' || CAST(asn AS VARCHAR) || '}}' AS snapshot FROM facet_obs""")
def chg11(spark, d):
    obs = standin(spark, d, "facet_obs")
    ev = build_event(
        obs, index="bb-assets", kind="state", category="asset", type_="ASSET_SNAPSHOT", ts=F.timestamp_micros("us"), context={"asset": {"id": F.col("asset_id").cast("string")}},
        body={"snapshot": {"http": F.struct("ip", "asn")}}, keep=["seq", "asset_id"],
    )
    return ev.select("seq", "asset_id", F.get_json_object("payload", "$.snapshot").alias("snapshot"))
