"""Stand-ins: the platform's tables as deterministic projections of the given ones.

Each is a source table plus expressions written in the SQL both engines share.  The few functions that differ are
spelled as macros: ``EPOCH(t)`` microseconds of a time stamp, ``AT(us)`` the reverse, ``SHA(x)``, ``HEX(n)``, ``LIST(a, b)``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from palisade.functions.common import literal_table

NOW_US = 1_706_659_200_000_000  # 2024-01-31 00:00:00
NOW = "2024-01-31 00:00:00"

_SPARK = {
    "EPOCH": "unix_micros(CAST({0} AS TIMESTAMP))", "AT": "timestamp_micros({0})", "SHA": "sha2({0}, 256)",
    "HEX": "lower(hex({0}))", "LIST": "array({0})",
}
_DUCK = {"EPOCH": "epoch_us({0})", "AT": "make_timestamp({0})", "SHA": "sha256({0})", "HEX": "printf('%x', {0})", "LIST": "[{0}]"}


def _expand(text: str, macros: dict[str, str]) -> str:
    """Replace macro calls, innermost last, with balanced parentheses."""
    while True:
        m = re.search(r"\b(EPOCH|AT|SHA|HEX|LIST)\(", text)
        if not m:
            return text
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[: m.start()] + macros[m.group(1)].format(text[m.end() : i - 1]) + text[i:]


def spark_sql(text: str) -> str:
    return _expand(text, _SPARK)


def duck(text: str) -> str:
    return _expand(text, _DUCK)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
_HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"
_IP = "(l_partkey * 2654435761 + l_orderkey * 97) % 4294967296"


def dotted(x: str) -> str:
    """Dotted quad of an integer expression."""
    parts = [f"CAST(CAST(floor({x} / {2 ** s}) AS BIGINT) % 256 AS STRING)" for s in (24, 16, 8, 0)]
    return " || '.' || ".join(parts)


# name -> (source, [expressions], filter)
STANDINS: dict[str, tuple[str, list[str], str | None]] = {
    "http_obs": ("pages", [
        "page_id", "url", f"{_HOST} AS host",
        "CASE page_id % 5 WHEN 2 THEN 301 WHEN 3 THEN 404 WHEN 4 THEN 500 ELSE 200 END AS status_code",
        "CASE page_id % 4 WHEN 0 THEN 'nginx/1.24.0 (Ubuntu)' WHEN 1 THEN 'Apache' WHEN 2 THEN 'Microsoft-IIS/10.0' END AS webserver",
        "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title",
        "regexp_replace(url, '#.*$', '') AS norm_url",
        "'203.0.' || CAST(page_id % 7 AS STRING) || '.' || CAST(page_id % 250 AS STRING) AS host_ip",
        f"AT({NOW_US} - (page_id * 7919 % 5184000) * 1000000) AS ts",
    ], None),
    "facet_obs": ("events", [
        "user_id AS asset_id", "event_id AS seq", "EPOCH(ts) AS us", f"{_K} AS k",
        "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 WHEN 'purchase' THEN 302 ELSE 200 END AS status_code",
        f"'192.0.2.' || CAST({_K} % 8 AS STRING) AS ip", f"CAST(64500 + {_K} % 3 AS BIGINT) AS asn", f"'fp' || CAST({_K} % 10 AS STRING) AS fingerprint",
    ], None),
    "jobs": ("orders", [
        "o_orderkey AS job_id", "CAST(o_custkey % 20 AS BIGINT) AS program_id", "CAST(floor(o_orderkey / 10) AS BIGINT) AS scan_id",
        "CASE o_orderkey % 8 WHEN 0 THEN 'dns' WHEN 1 THEN 'httpx' WHEN 2 THEN 'tlsx' WHEN 3 THEN 'uncover' WHEN 4 THEN 'mapcidr' "
        "WHEN 5 THEN 'katana' WHEN 6 THEN 'bbot' ELSE 'nuclei' END AS scanner",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED' WHEN o_orderkey % 13 = 0 THEN 'QUEUED' WHEN o_orderkey % 17 = 0 THEN 'BLOCKED' "
        "WHEN o_orderkey % 19 = 0 THEN 'OUT_OF_SCOPE' WHEN o_orderkey % 23 = 0 THEN 'CANCELLED' WHEN o_orderstatus = 'F' THEN 'SUCCESS' "
        "WHEN o_orderstatus = 'P' THEN 'RUNNING' ELSE 'PENDING' END AS status",
        "10 - 2 * CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority",
        "AT(EPOCH(o_orderdate) + (o_orderkey % 86400) * 1000000) AS created_at",
        "AT(EPOCH(o_orderdate) + (o_orderkey % 86400 + 60) * 1000000) AS queued_at",
        "AT(EPOCH(o_orderdate) + (o_orderkey % 86400 + 120) * 1000000) AS started_at",
        "AT(EPOCH(o_orderdate) + (o_orderkey % 86400 + 120 + o_orderkey % 900) * 1000000) AS finished_at",
        "'w' || CAST(o_orderkey % 50 AS STRING) AS worker_id", "CAST(o_orderkey % 5 AS INT) AS retry_count", "3 AS max_retries",
        "CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 = 0 THEN 'SCANNER_PAUSED' END AS block_reason",
        "CASE WHEN o_orderkey % 3 = 0 THEN AT(EPOCH(o_orderdate) + 86400000000) END AS next_attempt_at",
    ], None),
    "ips": ("(SELECT DISTINCT " + _IP + " AS ip_int FROM lineitem)", [
        "ip_int", "lpad(bin(ip_int), 32, '0') AS ip_bits", f"{dotted('ip_int')} AS ip",
    ], None),
    "ip_rows": ("lineitem", [
        "l_orderkey", "l_linenumber", f"{_IP} AS ip_int", f"lpad(bin({_IP}), 32, '0') AS ip_bits",
    ], None),
    "nets": (f"(SELECT DISTINCT {_IP} AS ip_int, 8 + l_partkey % 25 AS plen FROM lineitem)", [
        "CAST(floor(ip_int / pow(2, 32 - plen)) * pow(2, 32 - plen) AS BIGINT) AS lo",
        "CAST(floor(ip_int / pow(2, 32 - plen)) * pow(2, 32 - plen) + pow(2, 32 - plen) - 1 AS BIGINT) AS hi", "plen", "ip_int",
    ], None),
    "tech_obs": ("part", [
        "p_partkey AS asset_id",
        "CASE p_partkey % 5 WHEN 0 THEN 'nginx' WHEN 1 THEN 'apache-httpd' WHEN 2 THEN 'php' WHEN 3 THEN 'jquery' ELSE 'hsts' END AS technology",
        "CASE WHEN p_partkey % 5 < 4 THEN CAST(p_size % 9 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) END AS version",
    ], None),
    "cloud_src": ("supplier", [
        "s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 12 ELSE 16 END AS plen", "(s_suppkey * 2654435761) % 4294967296 AS x",
    ], None),
    "cloud_ranges": ("cloud_src", [
        "CASE s_suppkey % 4 WHEN 0 THEN 'amazon' WHEN 1 THEN 'google' WHEN 2 THEN 'cloudflare' ELSE 'azure' END AS provider",
        "CASE s_suppkey % 4 WHEN 0 THEN 'Amazon' WHEN 1 THEN 'Google' WHEN 2 THEN 'Cloudflare' ELSE 'Microsoft' END AS organization",
        "CASE WHEN s_suppkey % 4 = 2 THEN 'cdn' ELSE 'cloud' END AS category", "4 AS ip_version", "plen",
        "substring(lpad(bin(x), 32, '0'), 1, plen) AS net_bits",
        "'net-' || CAST(s_suppkey AS STRING) AS cidr",
    ], None),
    "asn_src": ("supplier", [
        "s_suppkey", "CAST((s_suppkey * 2654435761) % 4294967296 AS BIGINT) AS lo",
        "CAST((s_suppkey % 7 + 1) * 3000000 + s_suppkey % 1000 AS BIGINT) AS width",
    ], None),
    "asn_ranges": ("asn_src", [
        "lo", "CASE WHEN lo + width > 4294967295 THEN 4294967295 ELSE lo + width END AS hi", "4 AS ip_version",
        "CAST(64500 + s_suppkey AS BIGINT) AS asn",
        "CASE s_suppkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' END AS country", "'org-' || CAST(s_suppkey AS STRING) AS organization",
        "lpad(bin(lo), 32, '0') AS start_bits",
        "lpad(bin(CASE WHEN lo + width > 4294967295 THEN 4294967295 ELSE lo + width END), 32, '0') AS end_bits",
    ], None),
    "programs": ("nation", [
        "CAST(n_nationkey AS BIGINT) AS program_id", "lower(n_name) AS slug", "n_name AS name", "n_nationkey % 5 <> 0 AS active",
        f"CASE WHEN n_nationkey % 7 = 6 THEN AT({NOW_US}) END AS deleted_at",
    ], None),
    "assets": ("customer", [
        "c_custkey AS asset_id",
        "CASE c_custkey % 6 WHEN 0 THEN 'domain' WHEN 1 THEN 'subdomain' WHEN 2 THEN 'ipv4' WHEN 3 THEN 'url' WHEN 4 THEN 'technology' ELSE 'certificate' END AS asset_type",
        "CASE c_custkey % 6 WHEN 0 THEN 'c' || CAST(c_custkey AS STRING) || '.com' WHEN 1 THEN 'h' || CAST(c_custkey AS STRING) || '.example.com' "
        "WHEN 2 THEN '192.0.' || CAST(c_custkey % 4 AS STRING) || '.' || CAST(c_custkey % 251 AS STRING) "
        "WHEN 3 THEN 'https://h' || CAST(c_custkey AS STRING) || '.example.net/' WHEN 4 THEN 't' || CAST(c_custkey AS STRING) ELSE 'fp' || CAST(c_custkey AS STRING) END AS value",
        "CASE c_custkey % 5 WHEN 0 THEN 'discovered' WHEN 1 THEN 'active' WHEN 2 THEN 'inactive' WHEN 3 THEN 'retired' ELSE 'active' END AS status",
        "c_custkey % 17 = 0 AS paused", f"AT({NOW_US} - (c_custkey * 7919 % 5184000) * 1000000) AS last_seen",
        f"CASE WHEN c_custkey % 3 <> 0 THEN AT({NOW_US} - (c_custkey * 31 % 864000) * 1000000) END AS last_scanned", "c_nationkey",
    ], None),
    "links": ("customer", [
        "c_custkey AS asset_id", "CAST(c_nationkey AS BIGINT) AS program_id",
        "CASE c_custkey % 4 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN 'excluded' ELSE 'in_scope' END AS status",
    ], None),
    "states": ("(SELECT c_custkey, 'dns' AS facet FROM customer UNION ALL SELECT c_custkey, 'tls:443' AS facet FROM customer WHERE c_custkey % 2 = 0)", [
        "c_custkey AS asset_id", "facet", "'s' || CAST(c_custkey % 9 AS STRING) AS state",
    ], None),
    "edges": ("lineitem", [
        "l_orderkey AS source_id", "l_partkey AS target_id",
        "CASE l_linenumber % 4 WHEN 0 THEN 'RESOLVES_TO' WHEN 1 THEN 'HAS_URL' WHEN 2 THEN 'USES_TECHNOLOGY' ELSE 'CNAME_TO' END AS relationship_type",
        "l_suppkey", "EPOCH(l_shipdate) AS us", "l_linenumber", "l_extendedprice", "l_quantity",
    ], None),
    "scope_entries": ("customer", [
        "CAST(c_nationkey AS BIGINT) AS program_id", "CASE c_custkey % 3 WHEN 0 THEN 'wildcard' ELSE 'domain' END AS type",
        "CASE c_custkey % 3 WHEN 0 THEN '*.c' || CAST(c_custkey AS STRING) || '.com' ELSE 'c' || CAST(c_custkey AS STRING) || '.com' END AS value",
        "CASE WHEN c_custkey % 7 = 0 THEN 'exclude' ELSE 'include' END AS mode", "c_custkey % 10 <> 0 AS active",
    ], None),
    "audit": ("events", [
        "event_id AS audit_id", "CAST(ts AS TIMESTAMP) AS ts",
        "CASE event_type WHEN 'error' THEN 'SCOPE_BLOCKED' WHEN 'signup' THEN 'scan.started' WHEN 'purchase' THEN 'scope.created' ELSE 'sync.kev' END AS action",
    ], None),
    "deliveries": ("events", [
        "event_id AS delivery_id", "CAST(ts AS TIMESTAMP) AS created_at", "CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'sent' END AS status",
        "event_type",
    ], None),
    "windows": ("supplier", [
        "s_suppkey AS window_id", "CASE WHEN s_suppkey % 30 < 25 THEN CAST(s_suppkey % 30 AS BIGINT) END AS program_id",
        "CASE s_suppkey % 4 WHEN 0 THEN 'dns' WHEN 1 THEN 'httpx' WHEN 2 THEN 'nuclei' END AS scanner",
        "CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey * 3 AS BIGINT) END AS asset_id",
        f"AT({NOW_US} + (s_suppkey * 7919 % 172800 - 86400) * 1000000) AS start", f"AT({NOW_US} + (s_suppkey * 7919 % 172800 - 86400 + 36000) * 1000000) AS `end`",
    ], None),
    "controls": ("region", ["CASE r_regionkey WHEN 0 THEN 'dns' WHEN 1 THEN 'tlsx' ELSE 'x' || r_name END AS scanner", "r_regionkey = 1 AS paused"], None),
    "workers": ("customer", [
        "'w' || CAST(c_custkey AS STRING) AS worker_id",
        "CASE c_custkey % 4 WHEN 0 THEN 'dns' WHEN 1 THEN 'httpx' WHEN 2 THEN 'discovery' ELSE 'nuclei' END AS queue",
        "CASE WHEN c_custkey % 3 = 0 THEN 'j' || CAST(c_custkey AS STRING) END AS current_job",
    ], "c_custkey % 2 = 0"),
    "schedules": ("nation", [
        "n_nationkey AS schedule_id", "CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey AS BIGINT) END AS program_id", "n_nationkey % 3 <> 2 AS enabled",
        f"CASE WHEN n_nationkey % 5 <> 0 THEN AT({NOW_US} + (n_nationkey - 12) * 3600000000) END AS next_run_at",
        "CASE n_nationkey % 3 WHEN 0 THEN 'httpx' WHEN 1 THEN 'dns' ELSE 'katana' END AS scanner",
    ], None),
    "kev_prev": ("part", [
        "'CVE-2024-' || CAST(p_partkey AS STRING) AS cve_id", "p_brand AS vendor", "p_name AS product",
        f"CASE WHEN p_partkey % 20 = 3 THEN AT({NOW_US}) END AS removed_at",
    ], "p_partkey % 10 <> 0"),
    "kev_cur": ("part", [
        "'CVE-2024-' || CAST(p_partkey AS STRING) AS cve_id", "p_brand AS vendor",
        "CASE WHEN p_size % 4 = 0 THEN 'new ' || p_name ELSE p_name END AS product",
    ], "p_partkey % 10 <> 1"),
    "epss": ("part", [
        "'CVE-2024-' || CAST(p_partkey AS STRING) AS cve_id", "CAST(p_partkey % 1000 AS DOUBLE) / 1000 AS score", "CAST(p_partkey % 100 AS DOUBLE) / 100 AS percentile",
    ], None),
    "cves": ("part", [
        "'CVE-2024-' || CAST(p_partkey AS STRING) AS cve_id", "p_name AS description",
        "CASE p_partkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'CRITICAL' END AS cvss_severity", "CAST(p_partkey % 100 AS DOUBLE) / 10 AS cvss_score",
    ], "p_partkey % 3 <> 2"),
    "notes": ("events", [
        "event_id", "CAST(ts AS TIMESTAMP) AS ts",
        "CASE event_type WHEN 'error' THEN 'DLQ_EVENT' WHEN 'signup' THEN 'NEW_SUBDOMAIN' WHEN 'purchase' THEN 'KEV_ADDED' "
        "WHEN 'click' THEN 'TLS_CHANGED' ELSE 'HTTP_STATUS_CHANGED' END AS type",
        "CAST(user_id % 10 AS BIGINT) AS program_id", "CASE WHEN user_id % 3 <> 0 THEN 'program-' || CAST(user_id % 10 AS STRING) END AS program_name",
        "'a' || CAST(user_id AS STRING) AS asset_id", "'h' || CAST(user_id AS STRING) || '.example.com' AS asset_value",
        f"CASE WHEN {_K} % 4 <> 0 THEN 'v' || CAST({_K} AS STRING) END AS current", f"CASE WHEN {_K} % 3 = 0 THEN 'old' || CAST({_K} AS STRING) END AS previous",
        "'httpx' AS tool", "'j' || CAST(event_id % 50 AS STRING) AS job_id", f"'boom ' || CAST({_K} AS STRING) AS error_message", f"{_K} % 4 AS retry_count",
    ], None),
    "host_list": ("pages", ["page_id", f"{_HOST} AS host"], None),
}


# literal tables shared by both engines: name -> (schema, rows)
LITERALS: dict[str, tuple[str, list[tuple]]] = {
    "rule_rows": ("rule_id string, program_id string, type string, mode string, value string", [
        ("r01", "P1", "wildcard", "include", "*.example.com"), ("r02", "P1", "domain", "exclude", "www.cheap-pills.example.com"),
        ("r03", "P1", "wildcard", "include", "*.example.net"), ("r04", "P2", "wildcard", "include", "*.example.net"),
        ("r05", "P2", "domain", "exclude", "blog.tionsh.example.net"), ("r06", "P2", "domain", "include", "thther.example.org"),
        ("r07", "P3", "url", "include", "https://thther.example.org/en"), ("r08", "P3", "wildcard", "include", "*.example.org"),
        ("r09", "P3", "url", "exclude", "https://spam-farm.example.org/"), ("r10", "P1", "url", "exclude", "https://blog.tionsh.example.net/es"),
        ("r11", "P2", "wildcard", "exclude", "*.ththan.example.net"), ("r12", "P1", "domain", "include", "m.ththth.example.net"),
        ("r13", "P3", "url", "exclude", "http://thther.example.org/"), ("r14", "P4", "domain", "include", "example.com"),
    ]),
    "net_rules": ("rule_id string, program_id string, type string, mode string, value string, lo bigint, hi bigint", [
        ("n1", "P1", "cidr", "include", "0.0.0.0/2", 0, 1073741823), ("n2", "P1", "cidr", "include", "128.0.0.0/1", 2147483648, 4294967295),
        ("n3", "P1", "cidr", "exclude", "16.0.0.0/5", 268435456, 402653183), ("n4", "P1", "cidr", "exclude", "200.1.0.0/16", 3355508736, 3355574271),
        ("n5", "P2", "cidr", "include", "64.0.0.0/3", 1073741824, 1610612735), ("n6", "P2", "cidr", "exclude", "70.0.0.0/8", 1174405120, 1191182335),
        ("n7", "P2", "ipv4", "exclude", "80.1.2.3", 1342243331, 1342243331), ("n8", "P1", "cidr", "include", "16.0.0.0/4", 268435456, 536870911),
    ]),
    "policies": ("policy_id string, channel_id string, enabled boolean, program_id bigint, event_types string, min_severity string", [
        ("p1", "c1", True, None, "*", "medium"), ("p2", "c2", True, 3, "NEW_KEV,NEW_SUBDOMAIN", None), ("p3", "c1", True, 5, "*", "critical"),
        ("p4", "c3", True, None, "*", None), ("p5", "c2", False, None, "*", None), ("p6", "c2", True, None, "DLQ_EVENT", "low"),
    ]),
    "channels": ("channel_id string, enabled boolean", [("c1", True), ("c2", True), ("c3", False)]),
}


def _literal_sql(name: str) -> str:
    schema, rows = LITERALS[name]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    types = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE"}
    kinds = [types[c.strip().split(" ")[1]] for c in schema.split(",")]

    def lit(v: object, kind: str) -> str:
        text = "NULL" if v is None else ("true" if v is True else "false" if v is False else repr(v))
        return f"CAST({text} AS {kind})"

    body = ", ".join("(" + ", ".join(lit(v, k) for v, k in zip(r, kinds)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


def sql_bodies() -> dict[str, str]:
    """Definition of every stand-in for the checking engine."""
    out = {n: _literal_sql(n) for n in LITERALS}
    for name, (source, exprs, where) in STANDINS.items():
        cols = ", ".join(exprs).replace("`end`", '"end"').replace(" STRING)", " VARCHAR)")
        src = source.replace(" STRING)", " VARCHAR)")
        out[name] = duck(f"SELECT {cols} FROM {src}" + (" AS s" if source.startswith("(") else "") + (f" WHERE {where}" if where else ""))
    return out


def standin(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame over the given tables."""
    if name in LITERALS:
        schema, rows = LITERALS[name]
        return literal_table(spark, rows, schema)
    source, exprs, where = STANDINS[name]
    if source in STANDINS:
        df = standin(spark, d, source)
    elif source.startswith("("):
        tables = re.findall(r"FROM (\w+)", source)
        for t in tables:
            source = source.replace(f"FROM {t}", "FROM {" + t + "}")
        df = spark.sql("SELECT * FROM " + spark_sql(source), **{t: table(spark, d, t) for t in set(tables)})
    else:
        df = table(spark, d, source)
    if where:
        df = df.filter(spark_sql(where))
    return df.selectExpr(*[spark_sql(e) for e in exprs])
