"""Dashboards over index stand-ins; the check SQL is generated from the same panel list by an independent generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.catalogue.registry import register
from palisade.catalogue.standins import NOW, NOW_US, _K, duck, spark_sql, table
from palisade.plans import panels
from palisade.plans.base import staged, union


def _ts(key: str) -> str:
    return f"AT({NOW_US} - ({key} * 7919 % 5184000) * 1000000) AS ts"


_PROGRAM = "'program-' || CAST({} % 10 AS STRING) AS `program.name`"
_CHANGE = (
    "CASE event_id % 14 WHEN 0 THEN 'NEW_DOMAIN' WHEN 1 THEN 'NEW_SUBDOMAIN' WHEN 2 THEN 'NEW_IP' WHEN 3 THEN 'NEW_URL' WHEN 4 THEN 'NEW_CERTIFICATE' WHEN 5 THEN 'CERT_EXPIRING' WHEN 6 THEN 'TLS_CHANGED' "
    "WHEN 7 THEN 'SCOPE_BLOCKED' WHEN 8 THEN 'NEW_ENDPOINT' WHEN 9 THEN 'NEW_PORT' WHEN 10 THEN 'PORT_REMOVED' WHEN 11 THEN 'SAN_CHANGED' WHEN 12 THEN 'HTTP_STATUS_CHANGED' ELSE 'IP_CHANGED' END AS `event.type`"
)
_IP = "(l_partkey * 2654435761 + l_orderkey * 97) % 4294967296"
_H = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"

# index -> (source table, expressions with dotted field names)
INDICES: dict[str, tuple[str, list[str]]] = {
    "bb-assets": ("customer", [
        _ts("c_custkey"), "'bb-assets' AS `bb.index`", "'a' || CAST(c_custkey % 900 AS STRING) AS `asset.id`",
        "CASE c_nationkey % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'subdomain' WHEN 2 THEN 'ipv4' ELSE 'url' END AS `asset.type`", _PROGRAM.format("c_nationkey"),
    ]),
    "bb-http": ("pages", [
        _ts("page_id"), "'bb-http' AS `bb.index`", "regexp_replace(url, '#.*$', '') AS `url.full`", f"{_H} AS `url.domain`",
        "LIST('t' || CAST(page_id % 9 AS STRING), 't' || CAST(page_id % 4 AS STRING)) AS `technology.name`",
        "CASE WHEN page_id % 5 <> 0 THEN LIST('1.' || CAST(page_id % 6 AS STRING)) END AS `technology.version`",
        "CASE page_id % 5 WHEN 2 THEN 301 WHEN 3 THEN 404 WHEN 4 THEN 500 ELSE 200 END AS `http.response.status_code`",
        "CASE WHEN page_id % 3 = 0 THEN 'cdn' || CAST(page_id % 4 AS STRING) END AS `http.cdn.name`", "CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'waf' ELSE 'cdn' END END AS `http.cdn.type`",
        "page_id % 3 = 0 AS `http.cdn.detected`", "CASE WHEN page_id % 4 <> 3 THEN 'srv' || CAST(page_id % 4 AS STRING) END AS `http.webserver`",
        "regexp_extract(html, '<title>([^<]*)</title>', 1) AS `http.title`", "CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 13 AS STRING) END AS `http.favicon.mmh3`",
        "CASE WHEN page_id % 4 <> 0 THEN 64500 + page_id % 12 END AS `asn.number`", "CASE WHEN page_id % 3 = 1 THEN 'amazon' WHEN page_id % 3 = 2 THEN 'google' END AS `cloud.provider`", _PROGRAM.format("page_id"),
    ]),
    "bb-changes": ("events", [
        "CAST(ts AS TIMESTAMP) AS ts", "'bb-changes' AS `bb.index`", _CHANGE, "'a' || CAST(user_id AS STRING) AS `asset.id`", "'h' || CAST(user_id AS STRING) || '.example.com' AS `asset.value`",
        f"'v' || CAST({_K} % 5 AS STRING) AS `change.current`", "CASE WHEN event_id % 14 = 7 THEN CASE WHEN event_id % 4 = 1 THEN 'orchestrator' ELSE 'scanner_output' END END AS `scope_check.layer`",
        "CASE WHEN event_id % 14 = 7 THEN 'reason ' || CAST(user_id % 3 AS STRING) END AS `scope_check.reason`", _PROGRAM.format("user_id"),
    ]),
    "bb-tls": ("part", [
        _ts("p_partkey"), "'fp' || CAST(p_partkey % 700 AS STRING) AS `tls.fingerprint`", "CASE p_partkey % 5 WHEN 0 THEN 'expiring' WHEN 1 THEN 'expired' ELSE 'valid' END AS `tls.expiry_status`",
        "p_brand AS `tls.issuer_cn`", "CASE WHEN p_size % 3 = 0 THEN 'tls12' ELSE 'tls13' END AS `tls.version`", "p_type AS `tls.cipher`", "'h' || CAST(p_partkey % 60 AS STRING) || '.example.com' AS `asset.value`",
        "'2024-02-' || CAST(p_partkey % 3 + 10 AS STRING) AS `tls.not_after`",
    ]),
    "bb-certstream": ("pages", [
        _ts("page_id"), f"{_H} AS `asset.value`", "CASE page_id % 4 WHEN 0 THEN LIST('numeric') WHEN 1 THEN LIST('punycode', 'numeric') END AS `certstream.flags`", "page_id % 4 < 2 AS `certstream.interesting`",
    ]),
    "bb-cve": ("part", [
        _ts("p_partkey"), "'a' || CAST(p_partkey % 80 AS STRING) AS `asset.id`", "'h' || CAST(p_partkey % 80 AS STRING) || '.example.com' AS `asset.value`", "'CVE-2024-' || CAST(p_partkey % 150 AS STRING) AS `cve.id`",
        "p_partkey % 150 % 4 = 0 AS `kev.in_catalog`", "CASE WHEN p_size % 3 = 0 THEN 'detected' ELSE 'potential' END AS `vulnerability.status`",
        "CASE p_partkey % 150 % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'LOW' END AS `cvss.severity`", "CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS `cve.cpe_confidence_level`",
        "CAST(p_size % 6 AS STRING) || '.0' AS `technology.version`", "CAST(p_partkey % 997 AS DOUBLE) / 1000 AS `epss.score`",
    ]),
    "bb-kev": ("part", [
        _ts("p_partkey"), "'CVE-2024-' || CAST(p_partkey AS STRING) AS `cve.id`", "p_partkey % 9 <> 0 AS `kev.in_catalog`", "p_brand AS `kev.vendor`",
        "CASE p_partkey % 4 WHEN 0 THEN 'KEV_BASELINE' WHEN 1 THEN 'KEV_ADDED' WHEN 2 THEN 'KEV_UPDATED' ELSE 'KEV_REMOVED' END AS `event.type`",
    ]),
    "bb-nuclei": ("events", ["CAST(ts AS TIMESTAMP) AS ts", "CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'low' WHEN 'view' THEN 'info' ELSE 'medium' END AS `nuclei.severity`"]),
    "bb-urls": ("pages", [
        _ts("page_id"), "SHA(regexp_replace(url, '#.*$', '')) AS `url.hash`", "SHA(regexp_replace(url, '[?#].*$', '')) AS `url.endpoint_hash`", "page_id % 4 = 0 AS `url.js_discovered`", f"{_H} AS `url.domain`",
        "regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS `url.path`",
    ]),
    "bb-ips": ("lineitem", [
        _ts("l_orderkey"), "'bb-ips' AS `bb.index`", f"CAST({_IP} AS STRING) AS `host.ip`", "CASE l_suppkey % 4 WHEN 0 THEN 'amazon' WHEN 1 THEN 'google' WHEN 2 THEN 'cloudflare' END AS `cloud.provider`",
        "CASE WHEN l_suppkey % 3 <> 0 THEN 64500 + l_suppkey % 20 END AS `asn.number`", _PROGRAM.format("l_suppkey"),
    ]),
    "bb-bbot": ("events", [
        "CAST(ts AS TIMESTAMP) AS ts", "CASE event_id % 6 WHEN 0 THEN 'DNS_NAME' WHEN 1 THEN 'ASN' WHEN 2 THEN 'SCAN' WHEN 3 THEN 'TECHNOLOGY' WHEN 4 THEN 'OPEN_TCP_PORT' END AS `bbot.type`", "'m' || CAST(user_id % 20 AS STRING) AS `bbot.module`",
    ]),
    "bb-uncover": ("customer", [
        _ts("c_custkey"), "CASE WHEN c_custkey % 3 = 0 THEN 'shodan' ELSE 'fofa' END AS `uncover.engine`", "c_custkey % 4 <> 0 AS `scope_check.allowed`", "'h' || CAST(c_custkey % 40 AS STRING) || '.example.com' AS `asset.value`",
    ]),
    "bb-jobs": ("orders", [
        _ts("o_orderkey"), "CASE WHEN o_orderkey % 29 = 0 THEN 'queue' ELSE 'job' END AS `event.category`", "CASE WHEN o_orderkey % 29 = 0 THEN 'QUEUE_DEPTH' ELSE 'JOB' END AS `event.type`",
        "CASE WHEN o_orderkey % 29 <> 0 THEN CASE o_orderkey % 6 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'BLOCKED' WHEN 3 THEN 'OUT_OF_SCOPE' ELSE 'SUCCESS' END END AS `job.status`",
        "CASE WHEN o_orderkey % 29 <> 0 THEN 'scanner-' || CAST(o_custkey % 8 AS STRING) END AS `job.scanner`", "CASE WHEN o_orderkey % 6 = 2 AND o_orderkey % 29 <> 0 THEN 'reason-' || CAST(o_custkey % 3 AS STRING) END AS `job.block_reason`",
        "o_orderkey % 900 AS `job.duration_seconds`", "CASE WHEN o_orderkey % 29 = 0 THEN 'q' || CAST(o_custkey % 5 AS STRING) END AS `queue.name`", "o_orderkey % 77 AS `queue.pending`",
    ]),
    "bb-errors": ("events", [
        "CAST(ts AS TIMESTAMP) AS ts", "CASE WHEN event_type = 'error' THEN 'DLQ_EVENT' ELSE 'SCAN_FAILURE' END AS `event.type`", "'e' || CAST(event_id % 7 AS STRING) AS `error.type`", "CASE WHEN event_id % 5 <> 0 THEN 'tool' || CAST(user_id % 4 AS STRING) END AS `scan.tool`",
    ]),
    "bb-notifications": ("events", [
        "CAST(ts AS TIMESTAMP) AS ts", "event_type AS `notification.type`", "'c' || CAST(user_id % 3 AS STRING) AS `notification.channel`", "CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'deferred' ELSE 'sent' END AS `notification.status`",
    ]),
}
_ALL = ("bb-assets", "bb-http", "bb-changes", "bb-ips")
_ALL_FIELDS = ("ts", "bb.index", "asn.number", "cloud.provider", "program.name")


def _nest(df: DataFrame) -> DataFrame:
    """Dotted columns as nested structs."""

    def build(names: list[str], depth: int):
        groups: dict[str, list[str]] = {}
        for n in names:
            groups.setdefault(n.split(".")[depth], []).append(n)
        out = []
        for head, members in groups.items():
            leaf = [m for m in members if len(m.split(".")) == depth + 1]
            out.append((F.col(f"`{leaf[0]}`") if leaf else F.struct(*build(members, depth + 1))).alias(head))
        return out

    return df.select(*build(df.columns, 0))


def index_table(spark: SparkSession, d: str, index: str) -> DataFrame:
    if index == "bb-all":
        out = None
        for i in _ALL:
            source, exprs = INDICES[i]
            flat = table(spark, d, source).selectExpr(*map(spark_sql, exprs))
            part = flat.select(*[(F.col(f"`{f}`") if f in flat.columns else F.lit(None)).cast(t).alias(f) for f, t in zip(_ALL_FIELDS, ("timestamp", "string", "bigint", "string", "string"))])
            out = part if out is None else out.unionByName(part)
        return _nest(out)
    source, exprs = INDICES[index]
    return _nest(table(spark, d, source).selectExpr(*map(spark_sql, exprs)))


# --- check SQL -----------------------------------------------------------------------------------------------


def _index_sql(index: str) -> str:
    if index == "bb-all":
        parts = []
        for i in _ALL:
            names = [e.rsplit(" AS ", 1)[1].strip("`") for e in INDICES[i][1]]
            cols = ", ".join((f'"{f}"' if f in names else f"NULL AS \"{f}\"") for f in _ALL_FIELDS)
            parts.append(f"SELECT {cols} FROM ({_index_sql(i)})")
        return " UNION ALL ".join(parts)
    source, exprs = INDICES[index]
    return duck("SELECT " + ", ".join(exprs).replace("`", '"').replace(" STRING)", " VARCHAR)") + f" FROM {source}")


_LISTS = {"technology.name": ("bb-http",), "technology.version": ("bb-http",), "certstream.flags": ("bb-certstream",)}


def _literal(v: object) -> str:
    return str(v).lower() if isinstance(v, bool) else f"'{v}'"


def _where_sql(p: panels.Panel) -> str:
    now = f"TIMESTAMP '{NOW}'"
    parts = [f"ts >= {now} - INTERVAL 30 DAY", f"ts <= {now}"]
    w = p.where
    parts += [f'"{f}" IN ({", ".join(map(_literal, v))})' for f, v in w.equals.items()]
    parts += [f'("{f}" IS NULL OR "{f}" NOT IN ({", ".join(map(_literal, v))}))' for f, v in w.differs.items()]
    parts += [f'"{f}" IS NOT NULL' for f in w.exists]
    if w.hours is not None:
        parts.append(f"ts >= {now} - INTERVAL {w.hours} HOUR")
    return " AND ".join(parts)


def panel_sql(p: panels.Panel) -> str:
    """One panel as a SELECT of (panel, k1, k2, k3, value)."""
    docs = f"(SELECT *, row_number() OVER () AS rid FROM ({_index_sql(p.index)}) AS s WHERE {_where_sql(p)})"
    head = f"SELECT '{p.id}' AS panel, "
    nulls = "CAST(NULL AS VARCHAR) AS k1, CAST(NULL AS VARCHAR) AS k2, CAST(NULL AS VARCHAR) AS k3, "
    if p.kind == "count":
        return f"{head}{nulls} CAST(count(*) AS DOUBLE) AS value FROM {docs} AS t"
    if p.kind == "unique":
        return f'{head}{nulls} CAST(count(DISTINCT "{p.fields[0]}") AS DOUBLE) AS value FROM {docs} AS t'
    if p.kind == "series":
        f = p.fields[0]
        return (
            f"{head} strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS k1, CAST(\"{f}\" AS VARCHAR) AS k2, CAST(NULL AS VARCHAR) AS k3, CAST(count(*) AS DOUBLE) AS value FROM {docs} AS t "
            f"WHERE \"{f}\" IN (SELECT \"{f}\" FROM {docs} AS u WHERE \"{f}\" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, \"{f}\" LIMIT {p.size}) GROUP BY ALL"
        )
    # terms and tables: one level after another
    metric = f'{p.metric[0]}("{p.metric[1]}")' if p.metric else "count(*)"
    level, previous = "", ""
    for i in range(1, len(p.fields) + 1):
        cols = []
        for j, f in enumerate(p.fields[:i], 1):
            is_list = p.index in _LISTS.get(f, ())
            cols.append((f'unnest(list_distinct("{f}"))' if is_list else f'"{f}"') + f" AS c{j}")
        flat = docs
        for c in cols:  # unnest one list at a time, so that lists combine
            flat = f"(SELECT *, {c} FROM {flat} AS f)"
        keys = ", ".join(f"CAST(c{j} AS VARCHAR) AS k{j}" for j in range(1, i + 1))
        group = ", ".join(f"k{j}" for j in range(1, i + 1))
        present = " AND ".join(f"c{j} IS NOT NULL" for j in range(1, i + 1))
        inner = f"SELECT {keys}, {metric} AS value FROM {flat} AS g WHERE {present} GROUP BY {group}"
        if previous:
            match = " AND ".join(f"b.k{j} = a.k{j}" for j in range(1, i))
            inner = f"SELECT a.* FROM ({inner}) AS a WHERE EXISTS (SELECT 1 FROM ({previous}) AS b WHERE {match})"
        part = "PARTITION BY " + ", ".join(f"k{j}" for j in range(1, i)) if i > 1 else ""
        level = f"SELECT * FROM ({inner}) AS l QUALIFY row_number() OVER ({part} ORDER BY value DESC, k{i}) <= {p.size}"
        previous = level
    shown = ", ".join((f"k{j}" if j <= len(p.fields) else f"CAST(NULL AS VARCHAR) AS k{j}") for j in (1, 2, 3))
    return f"{head}{shown}, CAST(value AS DOUBLE) AS value FROM ({level}) AS x"


def dashboard_sql(name: str) -> str:
    body = " UNION ALL ".join(panel_sql(p) for p in panels.DASHBOARDS[name])
    return f"SELECT panel, k1, k2, k3, round(value, 6) AS value FROM ({body}) AS d"


def _register(name: str, number: int) -> None:
    def run(spark, d):
        used = {p.index for p in panels.DASHBOARDS[name]}
        indices = {i: index_table(spark, d, i) for i in used}
        out = panels.run_dashboard(indices, name, F.lit(NOW).cast("timestamp"))
        return out.withColumn("value", F.round("value", 6))

    register(f"pn{number}_{name}", dashboard_sql(name))(run)


for _i, _name in enumerate(panels.DASHBOARDS, 1):
    _register(_name, _i)


_UNIQUE = [p for d in panels.DASHBOARDS.values() for p in d if p.kind == "unique" and p.where.hours is None]


def _days_sql(p: panels.Panel) -> str:
    docs = f"(SELECT * FROM ({_index_sql(p.index)}) AS s WHERE {_where_sql(p).replace(_RECENT, _WHOLE_DAYS)})"
    return f'SELECT \'{p.id}\' AS panel, CAST(count(DISTINCT "{p.fields[0]}") AS BIGINT) AS exact, true AS close FROM {docs} AS t'


_RECENT = f"ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{NOW}'"
_WHOLE_DAYS = f"CAST(ts AS DATE) BETWEEN CAST(TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS DATE) AND CAST(TIMESTAMP '{NOW}' AS DATE)"


@register("ag11_daily_sketches", f"SELECT * FROM ({' UNION ALL '.join(map(_days_sql, _UNIQUE))}) AS d WHERE exact > 0")
def ag11_daily(spark, d):
    """Distinct values over thirty days from stored daily sketches, beside the exact number: whether they agree within 5 %."""
    now = F.lit(NOW).cast("timestamp")
    first, last = F.to_date(now - F.expr("INTERVAL 30 DAYS")), F.to_date(now)
    tables = {i: index_table(spark, d, i) for i in dict.fromkeys(p.index for p in _UNIQUE)}
    daily = union(*(panels.daily_sketches(df, [p for p in _UNIQUE if p.index == i], now) for i, df in tables.items()))
    estimated = panels.distinct_over_days(staged("daily-sketches")(daily), first, last)
    exact = union(*(tables[p.index].filter(F.to_date("ts").between(first, last) & p.where.column(now)).agg(F.countDistinct(p.fields[0]).alias("exact")).select(F.lit(p.id).alias("panel"), "exact") for p in _UNIQUE))
    return exact.join(estimated, "panel").select("panel", "exact", (F.abs(F.col("value") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))
