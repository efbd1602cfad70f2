"""Scope decisions; the checks decide every target against every rule by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue.registry import register
from palisade.catalogue.standins import _IP, STANDINS, dotted, standin, table
from palisade.functions.urls import normalize_urls
from palisade.operators import scope


def rules_of(spark, name: str = "rule_rows", where: str | None = None):
    raw = standin(spark, "", name)
    raw = raw.filter(where) if where else raw
    return scope.scope_rules(raw.select("rule_id", "program_id", "type", "mode", "value"))


# every target as kind, host, scheme, port, path
_URLS = """
    SELECT DISTINCT url AS target, norm_url AS value, 'url' AS kind, host, CASE WHEN url LIKE 'https:%' THEN 'https' ELSE 'http' END AS scheme,
           CASE WHEN regexp_extract(norm_url, '^https?://[^/?]+([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(norm_url, '^https?://[^/?]+([^?]*)', 1) END AS path FROM http_obs"""
_HOSTS = "SELECT DISTINCT host AS target, host AS value, 'domain' AS kind, host, CAST(NULL AS VARCHAR) AS scheme, CAST(NULL AS VARCHAR) AS path FROM http_obs"
_RULES = """
    SELECT *, CASE WHEN type = 'wildcard' THEN substring(value, 3) WHEN type = 'domain' THEN value END AS base, regexp_extract(value, '^(https?)://', 1) AS rscheme,
           regexp_extract(value, '^https?://([^/]+)', 1) AS rhost, regexp_replace(regexp_extract(value, '^https?://[^/]+(.*)$', 1), '/$', '') AS rpath FROM rule_rows"""
_HITS = """
    SELECT t.target, t.value AS tvalue, t.kind, r.*, CASE WHEN mode = 'exclude' THEN 0 ELSE 1 END AS turn,
           CASE WHEN mode = 'exclude' THEN CASE WHEN base IS NOT NULL THEN -(length(base) - length(replace(base, '.', '')) + 1) ELSE 0 END
                ELSE -(CASE WHEN type = 'wildcard' THEN 3 WHEN type = 'url' THEN 16 ELSE 15 END) END AS pos
    FROM scope_targets t JOIN scope_rules r ON
         (type = 'domain' AND (host = base OR (mode = 'exclude' AND host LIKE '%.' || base)))
      OR (type = 'wildcard' AND host LIKE '%.' || base)
      OR (type = 'url' AND kind = 'url' AND scheme = rscheme AND host = rhost AND (rpath = '' OR path = rpath OR starts_with(path, rpath || '/')))
      OR (type = 'url' AND kind = 'domain' AND mode = 'exclude' AND rpath = '' AND host = rhost)"""
_DECIDED = """
    SELECT *, turn = 1 AS allowed,
           CASE WHEN turn = 0 THEN 'explicit_exclusion' WHEN type = 'wildcard' THEN 'wildcard_inclusion' ELSE 'explicit_inclusion' END AS match_kind,
           CASE WHEN turn = 0 THEN 'excluded by exclude ' || type || ' ' || value WHEN type = 'wildcard' THEN 'matched ' || value || ' (wildcard)' ELSE 'matched ' || value END AS reason
    FROM scope_hits QUALIFY row_number() OVER (PARTITION BY target, program_id ORDER BY turn, pos, rule_id) = 1"""


def _ctes(targets: str, where: str = "true") -> dict[str, str]:
    return {"scope_targets": targets, "scope_rules": f"{_RULES} WHERE {where}", "scope_hits": _HITS, "scope_decided": _DECIDED}


_SHOW = "SELECT target, program_id, allowed, match_kind, rule_id AS scope_id, reason FROM scope_decided"
_COLUMNS = ["target", "program_id", "allowed", "match_kind", "scope_id", "reason"]


def _targets(spark, d, column: str):
    return standin(spark, d, "http_obs").select(F.col(column).alias("target"))


@register("jn1_scope", _SHOW, _ctes(f"{_URLS} UNION ALL {_HOSTS}"))
def jn1(spark, d):
    both = _targets(spark, d, "url").unionByName(_targets(spark, d, "host"))
    return scope.evaluate_scope(both, rules_of(spark)).select(*_COLUMNS)


_DOMAIN_RULES = "type IN ('domain', 'wildcard')"


@register("jn2_domain_rules", _SHOW, _ctes(_HOSTS, _DOMAIN_RULES))
def jn2(spark, d):
    return scope.evaluate_scope(_targets(spark, d, "host"), rules_of(spark, where=_DOMAIN_RULES)).select(*_COLUMNS)


def _net_sql(mode: str, source: str, target: str, cond: str) -> str:
    return f"""
        SELECT target, program_id, {'true' if mode == 'include' else 'false'} AS allowed, rule_id AS scope_id FROM (
            SELECT {target} AS target, s.lo, s.hi FROM {source} s) t JOIN net_rules r ON r.mode = '{mode}' AND {cond}
        QUALIFY row_number() OVER (PARTITION BY target, program_id ORDER BY {"CASE WHEN type = 'ipv4' THEN 0 ELSE 1 END, " if mode == 'include' else ''}rule_id) = 1"""


_NET_TEXT = f"{dotted('lo')} || '/' || CAST(plen AS STRING)"
_IPS_LOHI = {"ip_lohi": "SELECT ip_int AS lo, ip_int AS hi, ip FROM ips", "net_lohi": f"SELECT lo, hi, {_NET_TEXT.replace('STRING', 'VARCHAR')} AS net FROM nets"}


def _network_targets(spark, d):
    """The texts of ``ips`` and ``nets`` once per line item: the decision makes targets distinct, so nothing does it before."""
    ips = standin(spark, d, "ip_rows").selectExpr(f"{dotted('ip_int')} AS target")
    numbers = table(spark, d, "lineitem").selectExpr(f"{_IP} AS ip_int", "8 + l_partkey % 25 AS plen")
    nets = numbers.selectExpr(*STANDINS["nets"][1]).selectExpr(f"{_NET_TEXT} AS target")
    return ips.unionByName(nets)


@register("jn3_network_inclusion", _net_sql("include", "ip_lohi", "s.ip", "t.lo >= r.lo AND t.hi <= r.hi") + " UNION ALL "
          + _net_sql("include", "(SELECT DISTINCT * FROM net_lohi)", "s.net", "t.lo >= r.lo AND t.hi <= r.hi"), _IPS_LOHI)
def jn3(spark, d):
    return scope.evaluate_scope(_network_targets(spark, d), rules_of(spark, "net_rules", "mode = 'include'")).select("target", "program_id", "allowed", "scope_id")


@register("jn4_network_exclusion", _net_sql("exclude", "ip_lohi", "s.ip", "t.lo <= r.hi AND t.hi >= r.lo") + " UNION ALL "
          + _net_sql("exclude", "(SELECT DISTINCT * FROM net_lohi)", "s.net", "t.lo <= r.hi AND t.hi >= r.lo"), _IPS_LOHI)
def jn4(spark, d):
    return scope.evaluate_scope(_network_targets(spark, d), rules_of(spark, "net_rules", "mode = 'exclude'")).select("target", "program_id", "allowed", "scope_id")


@register("jn5_url_rules", _SHOW, _ctes(_URLS, "type = 'url'"))
def jn5(spark, d):
    return scope.evaluate_scope(_targets(spark, d, "url"), rules_of(spark, where="type = 'url'")).select(*_COLUMNS)


@register("jn6_origin_exclusion", _SHOW, _ctes(_HOSTS, "type = 'url'"))
def jn6(spark, d):
    return scope.evaluate_scope(_targets(spark, d, "host"), rules_of(spark, where="type = 'url'")).select(*_COLUMNS)


@register("jn7_asn_rules", """
    SELECT 'AS' || CAST(asn AS VARCHAR) AS target, CASE WHEN asn % 2 = 0 THEN 'P1' ELSE 'P2' END AS program_id, asn % 3 <> 0 AS allowed, 'r' || CAST(asn AS VARCHAR) AS scope_id
    FROM asn_ranges WHERE asn % 4 <> 3""")
def jn7(spark, d):
    asns = standin(spark, d, "asn_ranges")
    rules = asns.filter("asn % 4 <> 3").selectExpr(
        "'r' || CAST(asn AS STRING) AS rule_id", "CASE WHEN asn % 2 = 0 THEN 'P1' ELSE 'P2' END AS program_id", "'asn' AS type",
        "CASE WHEN asn % 3 <> 0 THEN 'include' ELSE 'exclude' END AS mode", "CAST(asn AS STRING) AS value",
    )
    targets = asns.selectExpr("'as' || CAST(asn AS STRING) AS target")
    out = scope.evaluate_scope(targets, scope.scope_rules(rules))
    return out.select(F.col("value").alias("target"), "program_id", "allowed", "scope_id")


@register("jn8_overall", """
    SELECT t.target, COALESCE(bool_or(allowed), false) AS allowed,
           COALESCE(string_agg(CASE WHEN allowed THEN program_id END, ',' ORDER BY program_id), '') AS allowed_programs,
           min(CASE WHEN allowed THEN program_id END) AS first_allowed,
           CASE WHEN bool_or(allowed) THEN min_by(reason, program_id) FILTER (WHERE allowed) WHEN count(program_id) > 0 THEN min_by(reason, program_id) ELSE 'not in approved scope' END AS reason
    FROM scope_targets t LEFT JOIN scope_decided d ON t.target = d.target GROUP BY t.target""", _ctes(_URLS))
def jn8(spark, d):
    out = scope.scope_overall(_targets(spark, d, "url"), rules_of(spark))
    return out.select(
        "target", "allowed", F.array_join("allowed_programs", ",").alias("allowed_programs"), F.when(F.col("allowed"), F.col("program_id")).alias("first_allowed"), "reason"
    )


@register("jn9_host_exclusions", """
    SELECT DISTINCT h.host, r.program_id, r.base AS excluded FROM host_list h JOIN scope_rules r ON r.mode = 'exclude' AND r.base IS NOT NULL AND
        (h.host = r.base OR h.host LIKE '%.' || r.base OR r.base LIKE '%.' || h.host)""", {"scope_rules": _RULES})
def jn9(spark, d):
    rules = rules_of(spark)
    hosts = standin(spark, d, "host_list").select("host").distinct()
    # every (host, program) pair: a host may be scanned for any of the few programs with exclusions
    pairs = hosts.select("host", F.explode(F.array(*map(F.lit, ("P1", "P2", "P3")))).alias("program_id"))
    return scope.host_exclusions(pairs, rules)


@register("jn10_url_exclusions", """
    SELECT DISTINCT h.host, r.program_id, r.rule_id, r.value AS url FROM host_list h JOIN scope_rules r ON r.mode = 'exclude' AND r.type = 'url' AND r.rhost = h.host""", {"scope_rules": _RULES})
def jn10(spark, d):
    hosts = standin(spark, d, "host_list").select("host").distinct()
    pairs = hosts.select("host", F.explode(F.array(*map(F.lit, ("P1", "P2", "P3")))).alias("program_id"))
    return scope.url_exclusions(pairs, rules_of(spark)).select("host", "program_id", "rule_id", "url")


@register("jn21_output_validation", """
    SELECT page_id, CASE WHEN d.allowed AND page_id % 3 = 0 THEN false ELSE COALESCE(d.allowed, false) END AS allowed,
           CASE WHEN d.allowed AND page_id % 3 = 0 THEN 'connected IP ' || host_ip || ' differs from validated IPs' ELSE COALESCE(d.reason, 'not in approved scope') END AS reason
    FROM http_obs h LEFT JOIN scope_decided d ON h.url = d.target AND d.program_id = 'P1'""", _ctes(_URLS))
def jn21(spark, d):
    obs = standin(spark, d, "http_obs").select(
        "page_id", "url", F.lit("P1").alias("program_id"), "host_ip",
        F.when(F.col("page_id") % 3 == 0, F.array(F.lit("192.0.2.1"))).when(F.col("page_id") % 3 == 1, F.array("host_ip")).otherwise(F.array().cast("array<string>")).alias("pinned"),
    )
    out = scope.validate_output(obs, rules_of(spark), "url", "program_id", "host_ip", "pinned")
    return out.select("page_id", "decision.allowed", "decision.reason")


def _sensitive_sql() -> str:
    from palisade.catalogue.normalising import _ranges

    return f"""
        SELECT name, program_id, CAST(count(*) AS BIGINT) AS bad_ips FROM (SELECT DISTINCT 'h' || CAST(ip_int % 1000 AS VARCHAR) || '.example.com' AS name, 'P1' AS program_id, ip_int AS x FROM ips)
        WHERE {_ranges('x')} AND NOT (EXISTS (SELECT 1 FROM net_rules r WHERE r.program_id = 'P1' AND r.mode = 'include' AND x BETWEEN r.lo AND r.hi)
              AND NOT EXISTS (SELECT 1 FROM net_rules r WHERE r.program_id = 'P1' AND r.mode = 'exclude' AND x BETWEEN r.lo AND r.hi)) GROUP BY ALL"""


@register("jn22_private_resolution", _sensitive_sql())
def jn22(spark, d):
    names = standin(spark, d, "ips").selectExpr("'h' || CAST(ip_int % 1000 AS STRING) || '.example.com' AS name", "'P1' AS program_id", "ip")
    return scope.private_resolution(names, rules_of(spark, "net_rules")).select("name", "program_id", "bad_ips")


@register("ob6_exclusion_patterns", r"""
    SELECT DISTINCT 'P1' AS program_id, 'https://' || host AS origin, '^https://' || replace(host, '.', '\.') || '/es(/|\?|#|$)' AS pattern
    FROM http_obs WHERE host = 'blog.tionsh.example.net' AND url LIKE 'https:%'""")
def ob6(spark, d):
    origins = normalize_urls(standin(spark, d, "http_obs").select("url", F.lit("P1").alias("program_id")), "url", "u")
    return scope.exclusion_patterns(origins.select("program_id", F.col("u").alias("url")), rules_of(spark))


@register("flagship_scope_by_program", """
    SELECT program_id, match_kind, allowed, CAST(count(*) AS BIGINT) AS urls FROM scope_decided GROUP BY ALL""", _ctes(_URLS))
def flagship(spark, d):
    """Which observed URLs are in scope, for which program, by which kind of rule."""
    out = scope.evaluate_scope(_targets(spark, d, "url"), rules_of(spark))
    return out.groupBy("program_id", "match_kind", "allowed").agg(F.count(F.lit(1)).alias("urls"))


_MANY_HOSTS = "SELECT DISTINCT l_orderkey AS k, 'h' || CAST(l_partkey AS VARCHAR) || '.o' || CAST(l_orderkey AS VARCHAR) || '.com' AS target FROM lineitem"


@register("jn1_many_rules", """
    SELECT h.target, CASE WHEN k % 2 = 0 THEN 'P1' ELSE 'P2' END AS program_id, k % 7 <> 3 AS allowed, 'r' || CAST(k AS VARCHAR) AS scope_id FROM many_hosts h JOIN orders ON o_orderkey = k""", {"many_hosts": _MANY_HOSTS})
def jn1_many(spark, d):
    """As many rules as orders, as many hosts as line items."""
    rules = table(spark, d, "orders").selectExpr(
        "'r' || CAST(o_orderkey AS STRING) AS rule_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'P1' ELSE 'P2' END AS program_id", "'wildcard' AS type",
        "CASE WHEN o_orderkey % 7 <> 3 THEN 'include' ELSE 'exclude' END AS mode", "'*.o' || CAST(o_orderkey AS STRING) || '.com' AS value",
    )
    targets = table(spark, d, "lineitem").selectExpr("'h' || CAST(l_partkey AS STRING) || '.o' || CAST(l_orderkey AS STRING) || '.com' AS target")
    return scope.evaluate_scope(targets, scope.scope_rules(rules)).select("target", "program_id", "allowed", "scope_id")
