"""Sources and sinks: text and JSON made of the given tables, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalogue.registry import register
from palisade.catalogue.standins import NOW, NOW_US, dotted, spark_sql, standin, table
from palisade.operators import merge
from palisade.session import scratch_dir
from palisade.sources import certificates, events, records


def _json(*pairs: tuple[str, str]) -> str:
    """Concatenation building a JSON object; values are SQL expressions giving JSON text."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in pairs) + " || '}'"


def _q(expr: str) -> str:
    return f"'\"' || {expr} || '\"'"


_LINE = (
    "CASE page_id % 10 WHEN 7 THEN 'this is not json' WHEN 8 THEN '[\"x\"]' WHEN 9 THEN '   ' ELSE "
    + _json(("url", _q("url")), ("status_code", "CAST(status_code AS STRING)")) + " END"
)


@register("src1_jsonl", """
    SELECT page_id, CASE WHEN page_id % 10 < 7 THEN url END AS url, CASE WHEN page_id % 10 < 7 THEN status_code END AS status_code,
           CASE page_id % 10 WHEN 7 THEN 'this is not json' WHEN 8 THEN '["x"]' END AS malformed FROM http_obs WHERE page_id % 10 <> 9""")
def src1(spark, d):
    lines = standin(spark, d, "http_obs").selectExpr("page_id", f"{_LINE} AS value")
    return records.parse_jsonl(lines, "url string, status_code int").select("page_id", "record.url", "record.status_code", "malformed")


_ENTRY = "CASE page_id % 6 WHEN 0 THEN '*.' || host WHEN 1 THEN upper(host) WHEN 2 THEN host_ip WHEN 3 THEN '# comment' WHEN 4 THEN '-' || host ELSE ' ' || host || ' ' END"


@register("src2_domain_list", """
    SELECT DISTINCT CASE page_id % 6 WHEN 0 THEN '*.' || host WHEN 2 THEN host_ip WHEN 4 THEN '-' || host ELSE host END AS value,
           CASE page_id % 6 WHEN 0 THEN 'wildcard' WHEN 2 THEN 'ipv4' WHEN 4 THEN 'rejected: invalid_label' ELSE 'domain' END AS outcome
    FROM http_obs WHERE page_id % 6 <> 3""")
def src2(spark, d):
    lines = standin(spark, d, "http_obs").selectExpr(f"{_ENTRY} AS value")
    good, bad = records.parse_domain_list(lines)
    rejected = bad.select(F.col("raw").alias("value"), F.concat(F.lit("rejected: "), "error").alias("outcome"))
    return good.select("value", F.col("type").alias("outcome")).unionByName(rejected)


@register("src3_cidr_list", f"""
    SELECT DISTINCT CASE WHEN ip_int % 5 = 0 THEN 'x' || CAST(ip_int AS VARCHAR) ELSE {dotted('lo').replace('STRING', 'VARCHAR')} || '/' || CAST(plen AS VARCHAR) END AS value,
           CASE WHEN ip_int % 5 = 0 THEN 'rejected' ELSE 'network' END AS outcome FROM nets""")
def src3(spark, d):
    text = f"CASE WHEN ip_int % 5 = 0 THEN 'x' || CAST(ip_int AS STRING) ELSE {dotted('ip_int')} || '/' || CAST(plen AS STRING) END AS value"
    good, bad = records.parse_cidr_list(standin(spark, d, "nets").selectExpr(text))
    return good.select(F.col("cidr").alias("value"), F.lit("network").alias("outcome")).unionByName(bad.select(F.col("raw").alias("value"), F.lit("rejected").alias("outcome")))


_TSV = (
    f"{dotted('lo')} || chr(9) || {dotted('hi')} || chr(9) || CASE WHEN asn % 10 = 3 THEN '0' ELSE CAST(asn AS STRING) END || chr(9) || "
    "COALESCE(country, 'None') || CASE WHEN asn % 10 = 4 THEN '' ELSE chr(9) || organization END"
)


@register("src4_asn_tsv", f"""
    SELECT {dotted('lo').replace('STRING', 'VARCHAR')} AS start_ip, {dotted('hi').replace('STRING', 'VARCHAR')} AS end_ip, start_bits, asn, country, organization
    FROM asn_ranges WHERE asn % 10 NOT IN (3, 4)""")
def src4(spark, d):
    lines = standin(spark, d, "asn_ranges").selectExpr(f"{_TSV} AS value")
    return records.parse_asn_tsv(lines).select("start_ip", "end_ip", "start_bits", "asn", "country", "organization")


@register("src5_epss", """
    SELECT 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve_id, CAST(p_partkey % 1000 AS DOUBLE) / 1000 AS score, CAST(p_size AS DOUBLE) / 100 AS percentile,
           'v2024.01.30' AS model_version, '2024-01-30' AS score_date FROM part WHERE p_partkey % 9 < 7""")
def src5(spark, d):
    parts = table(spark, d, "part").selectExpr(
        "CASE WHEN p_partkey % 9 = 7 THEN 'bad,line' WHEN p_partkey % 9 = 8 THEN 'CVE-X,2,3' ELSE 'cve-2024-' || CAST(p_partkey AS STRING) || ',' || "
        "CAST(p_partkey % 1000 AS DOUBLE) / 1000 || ',' || CAST(p_size AS DOUBLE) / 100 END AS value"
    )
    header = table(spark, d, "region").filter("r_regionkey < 2").selectExpr(
        "CASE r_regionkey WHEN 0 THEN '#model_version:v2024.01.30,score_date:2024-01-30T00:00:00Z' ELSE 'cve,epss,percentile' END AS value"
    )
    scores, meta = records.parse_epss(header.unionByName(parts))
    one = F.broadcast(meta.select("model_version", F.col("score_date").cast("string").alias("score_date"), F.lit(1).alias("one")))
    return scores.withColumn("one", F.lit(1)).join(one, "one").drop("one")


_KEV_DOC = (
    "'{\"catalogVersion\":\"1\",\"vulnerabilities\":[' || "
    + _json(("cveID", _q("'CVE-2024-' || CAST(p_partkey AS STRING)")), ("product", _q("'old'")))
    + " || ',{\"cveID\":\"not-a-cve\"},' || "
    + _json(("cveID", _q("' cve-2024-' || CAST(p_partkey AS STRING)")), ("product", _q("p_name")), ("vendorProject", _q("p_brand")), ("dateAdded", _q("'2024-01-02'")), ("cwes", "'[\"CWE-79\"]'"))
    + " || ']}'"
)


@register("src6_kev", """
    SELECT 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve_id, p_brand AS vendor, p_name AS product, '2024-01-02' AS date_added, 'CWE-79' AS cwe, '1' AS catalog_version FROM part""")
def src6(spark, d):
    docs = table(spark, d, "part").selectExpr(f"{_KEV_DOC} AS value")
    return records.parse_kev(docs).select(
        "cve_id", "vendor", "product", F.col("date_added").cast("string").alias("date_added"), F.array_join("cwes", ",").alias("cwe"), "catalog_version"
    )


_CVE_DOC = (
    "'{\"id\":\"CVE-2024-' || CAST(p_partkey AS STRING) || '\",\"descriptions\":[{\"lang\":\"es\",\"value\":\"x\"},{\"lang\":\"en\",\"value\":\"' || p_name || '\"}],"
    "\"metrics\":{\"cvssMetricV2\":[{\"type\":\"Primary\",\"baseSeverity\":\"LOW\",\"cvssData\":{\"baseScore\":5.0,\"vectorString\":\"AV:N\"}}]' || "
    "CASE WHEN p_partkey % 2 = 0 THEN ',\"cvssMetricV31\":[{\"type\":\"Secondary\",\"cvssData\":{\"baseScore\":9.1,\"baseSeverity\":\"CRITICAL\"}},"
    "{\"type\":\"Primary\",\"cvssData\":{\"baseScore\":' || CAST(p_size AS STRING) || ',\"vectorString\":\"p\",\"baseSeverity\":\"HIGH\"}}]' ELSE '' END || "
    "'},\"weaknesses\":[{\"description\":[{\"value\":\"CWE-787\"},{\"value\":\"NVD-CWE-noinfo\"},{\"value\":\"CWE-20\"},{\"value\":\"CWE-787\"}]}]}'"
)


@register("src7_cve", """
    SELECT 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve_id, p_name AS description, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS cvss_score,
           CASE WHEN p_partkey % 2 = 0 THEN '3.1' ELSE '2.0' END AS cvss_version, CASE WHEN p_partkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS cvss_severity,
           CASE WHEN p_partkey % 2 = 0 THEN 'p' ELSE 'AV:N' END AS cvss_vector, 'CWE-20,CWE-787' AS cwes FROM part""")
def src7(spark, d):
    docs = table(spark, d, "part").selectExpr(f"{_CVE_DOC} AS value")
    return records.parse_cve(docs).select("cve_id", "description", "cvss_score", "cvss_version", "cvss_severity", "cvss_vector", F.array_join("cwes", ",").alias("cwes"))


CT_MESSAGE = (
    "CASE WHEN page_id % 7 = 6 THEN '{\"message_type\":\"heartbeat\"}' ELSE '{\"message_type\":\"certificate_update\",\"data\":{\"leaf_cert\":{\"subject\":{\"CN\":\"' || upper(host) || '.\"},"
    "\"extensions\":{\"subjectAltName\":\"DNS:' || host || ', DNS:bad..name\"},' || "
    "CASE WHEN page_id % 2 = 0 THEN '\"sha256\":\"' || upper(SHA(url)) || '\"' ELSE '\"fingerprint\":\"AB:' || CAST(page_id AS STRING) || '\"' END || "
    "',\"all_domains\":[\"' || host || '\",\"*.' || regexp_replace(host, '^[^.]+[.]', '') || '\"]},\"cert_index\":' || CAST(page_id AS STRING) || ',\"seen\":' || CAST(1706000000 + page_id * 3600 AS STRING) || '}}' END"
)


@register("src8_ct", """
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN SHA(url) ELSE 'sha1:ab' || CAST(page_id AS VARCHAR) END AS fingerprint, host AS domains,
           '*.' || regexp_replace(host, '^[^.]+[.]', '') AS wildcards, 'bad..name' AS invalid_names, CAST(1706000000 + page_id * 3600 AS BIGINT) AS seen, page_id AS cert_index
    FROM http_obs WHERE page_id % 7 <> 6""")
def src8(spark, d):
    msgs = standin(spark, d, "http_obs").selectExpr("page_id", spark_sql(f"{CT_MESSAGE} AS value"))
    return certificates.parse_ct(msgs).select(
        "page_id", "fingerprint", F.array_join("domains", ",").alias("domains"), F.array_join("wildcards", ",").alias("wildcards"),
        F.array_join("invalid_names", ",").alias("invalid_names"), F.unix_seconds("seen").alias("seen"), "cert_index",
    )


# event documents: 1 % broken, 1 % without type, 1 % of a foreign index
_DAY = "2024-01-15T00:00:00Z"
EVENT_LINE = (
    "CASE event_id % 100 WHEN 7 THEN '{broken ' || CAST(event_id AS STRING) ELSE '{\"@timestamp\":\"' || CASE WHEN event_id % 2 = 0 THEN '2024-01-15T00:00:00Z' ELSE '2023-12-20T00:00:00Z' END || "
    "'\",\"event\":{\"kind\":\"event\",\"category\":\"change\"' || CASE WHEN event_id % 100 = 8 THEN '' ELSE ',\"type\":\"' || event_type || '\"' END || '},\"bb\":{\"index\":\"' || "
    "CASE WHEN event_id % 100 = 9 THEN 'foreign' WHEN event_id % 3 = 0 THEN 'bb-http' WHEN event_id % 3 = 1 THEN 'bb-changes' ELSE 'bb-jobs' END || '\"' || "
    "CASE WHEN event_id % 3 = 2 THEN ',\"doc_id\":\"d' || CAST(user_id AS STRING) || '\"' ELSE '' END || '}}' END"
)
_RAW = f"""
    SELECT event_id, user_id, event_type,
           CASE event_id % 100 WHEN 7 THEN 'MALFORMED_EVENT' WHEN 8 THEN 'MISSING_REQUIRED_FIELD' WHEN 9 THEN 'INDEX_NOT_ALLOWED' END AS error_type,
           CASE WHEN event_id % 100 IN (7, 8, 9) THEN 'bb-errors' WHEN event_id % 3 = 0 THEN 'bb-http' WHEN event_id % 3 = 1 THEN 'bb-changes' ELSE 'bb-jobs' END AS idx,
           CASE WHEN event_id % 100 <> 7 THEN CASE WHEN event_id % 2 = 0 THEN '2024.01' ELSE '2023.12' END END AS ym,
           CASE WHEN event_id % 3 = 2 AND event_id % 100 NOT IN (7, 8, 9) THEN 'd' || CAST(user_id AS VARCHAR) END AS doc_id
    FROM events"""


def event_lines(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{EVENT_LINE} AS value")


@register("src9_events", "SELECT event_id, idx AS index, doc_id, error_type, ym FROM raw_events", {"raw_events": _RAW})
def src9(spark, d):
    return events.validate_events(event_lines(spark, d)).select("event_id", "index", "doc_id", "error_type", "ym")


@register("src10_index_pattern", """
    SELECT idx AS index, ym, CAST(count(*) AS BIGINT) AS n FROM raw_events WHERE idx LIKE 'bb-h%' GROUP BY ALL""", {"raw_events": _RAW})
def src10(spark, d):
    valid = events.validate_events(event_lines(spark, d))
    return events.matching(valid, "bb-h*").groupBy("index", "ym").agg(F.count(F.lit(1)).alias("n"))


_FINDING = (
    "'{\"template-id\":\"t' || CAST(page_id % 5 AS STRING) || '\",\"host\":\"' || host || '\"' || CASE WHEN page_id % 3 = 0 THEN '' ELSE ',\"matched-at\":\"' || url || '\"' END || "
    "',\"info\":{\"name\":\"n\"' || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN ',\"severity\":\"high\"' ELSE ',\"severity\":\"low\",\"classification\":{\"cve-id\":[\"cve-2024-1\"]}' END || '}}'"
)


@register("src11_import_findings", """
    SELECT page_id, 't' || CAST(page_id % 5 AS VARCHAR) AS template_id, CASE WHEN page_id % 3 = 0 THEN host ELSE url END AS asset_value,
           CASE page_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'high' ELSE 'low' END AS severity, CASE WHEN page_id % 3 <> 0 THEN url END AS matched_at,
           CASE WHEN page_id % 4 > 1 THEN '["cve-2024-1"]' ELSE '[]' END AS cve_ids, 'lab' AS program FROM http_obs""")
def src11(spark, d):
    lines = standin(spark, d, "http_obs").selectExpr("page_id", f"{_FINDING} AS value")
    out = records.import_findings(lines, program="lab")
    at = lambda p: F.get_json_object("payload", p)
    return out.select(
        "page_id", "template_id", "asset_value", "severity", at("$.nuclei.matched_at").alias("matched_at"), at("$.nuclei.cve_ids").alias("cve_ids"), at("$.program.name").alias("program")
    )


# --- sinks -------------------------------------------------------------------------------------------------


@register("snk1_write_events", """
    SELECT idx AS index, ym, CAST(count(*) AS BIGINT) AS n, CAST(count(doc_id) AS BIGINT) AS with_id FROM raw_events WHERE error_type IS NULL GROUP BY ALL""", {"raw_events": _RAW})
def snk1(spark, d):
    path = scratch_dir(spark, "events")
    good = events.validate_events(event_lines(spark, d)).filter("error_type IS NULL")
    events.write_events(good.drop("error_type", "error_message"), path)
    back = events.read_events(spark, path)
    return back.groupBy("index", "ym").agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("with_id"))


_DOC_ROWS = """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'bb-jobs' ELSE 'bb-kev' END AS idx, CASE WHEN event_id % 5 < 3 THEN '2024.01' ELSE '2024.02' END AS ym,
           CASE WHEN event_id % 10 <> 9 THEN 'd' || CAST(user_id AS VARCHAR) END AS doc_id, ts FROM events"""


@register("snk2_latest_docs", """
    SELECT event_id, idx AS index, ym, doc_id FROM doc_rows
    QUALIFY doc_id IS NULL OR row_number() OVER (PARTITION BY idx, ym, doc_id ORDER BY ts DESC, event_id DESC) = 1""", {"doc_rows": _DOC_ROWS})
def snk2(spark, d):
    docs = table(spark, d, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 2 = 0 THEN 'bb-jobs' ELSE 'bb-kev' END AS index", "CASE WHEN event_id % 5 < 3 THEN '2024.01' ELSE '2024.02' END AS ym",
        "CASE WHEN event_id % 10 <> 9 THEN 'd' || CAST(user_id AS STRING) END AS doc_id", "ts",
    )
    return events.latest_docs(docs, "event_id").select("event_id", "index", "ym", "doc_id")


@register("snk3_replace_table", """
    SELECT lo, hi, asn FROM (SELECT l_suppkey % 50 AS lo, l_partkey AS hi, l_orderkey * 10 + l_linenumber AS asn FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY lo ORDER BY hi DESC, asn) = 1""")
def snk3(spark, d):
    new = table(spark, d, "lineitem").selectExpr("l_suppkey % 50 AS lo", "l_partkey AS hi", "l_orderkey * 10 + l_linenumber AS asn")
    path = scratch_dir(spark, "replaced")
    events.replace_table(new, path, ["lo"], [-F.col("hi"), F.col("asn")], min_rows=1000)
    return events.read_snapshot(spark, path)


@register("snk4_upsert_scores", """
    SELECT COALESCE(n.cve_id, o.cve_id) AS cve_id, COALESCE(n.score, o.score) AS score, o.cve_id IS NULL AS inserted
    FROM (SELECT cve_id, score FROM epss WHERE score < 0.7) o
    FULL JOIN (SELECT cve_id, score + 1 AS score FROM epss WHERE score >= 0.3) n ON o.cve_id = n.cve_id""")
def snk4(spark, d):
    epss = standin(spark, d, "epss")
    cur = epss.filter("score < 0.7").select("cve_id", "score")
    new = epss.filter("score >= 0.3").select("cve_id", (F.col("score") + 1).alias("score"), F.lit(1).alias("seq"))
    return merge.upsert_last(cur, new, ["cve_id"], ["seq"])


@register("snk5_retention", f"""
    SELECT event_id, idx AS index, ym FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bb-httpx-raw' WHEN 1 THEN 'bb-certstream' WHEN 2 THEN 'bb-http' ELSE 'bb-assets' END AS idx,
        CASE event_id % 5 WHEN 0 THEN '2023.09' WHEN 1 THEN '2023.11' WHEN 2 THEN '2023.12' ELSE '2024.01' END AS ym FROM events)
    WHERE date_diff('day', last_day(strptime(ym || '.01', '%Y.%m.%d')), DATE '{NOW[:10]}') <= CASE idx WHEN 'bb-httpx-raw' THEN 30 WHEN 'bb-certstream' THEN 60 WHEN 'bb-http' THEN 90 ELSE 730 END""")
def snk5(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id", "CASE event_id % 4 WHEN 0 THEN 'bb-httpx-raw' WHEN 1 THEN 'bb-certstream' WHEN 2 THEN 'bb-http' ELSE 'bb-assets' END AS index",
        "CASE event_id % 5 WHEN 0 THEN '2023.09' WHEN 1 THEN '2023.11' WHEN 2 THEN '2023.12' ELSE '2024.01' END AS ym",
    )
    return events.apply_retention(rows, F.lit(NOW).cast("timestamp")).select("event_id", "index", "ym")


@register("flt11_validate", "SELECT idx AS index, error_type, CAST(count(*) AS BIGINT) AS n FROM raw_events GROUP BY ALL", {"raw_events": _RAW})
def flt11(spark, d):
    return events.validate_events(event_lines(spark, d)).groupBy("index", "error_type").agg(F.count(F.lit(1)).alias("n"))


@register("flt12_build_event", f"""
    SELECT seq, '{{"@timestamp":"2024-01-31T00:00:00.000Z","event":{{"kind":"event","category":"change","type":"IP_CHANGED","action":"IP_CHANGED"}},"bb":{{"index":"bb-changes","schema_version":"1"}},'
        || '"asset":{{"id":"' || CAST(asset_id AS VARCHAR) || '","value":"' || fingerprint || '"}}'
        || CASE WHEN k % 2 = 0 THEN ',"change":{{"current":"' || ip || '"}}' ELSE '' END || '}}' AS payload FROM facet_obs""")
def flt12(spark, d):
    df = standin(spark, d, "facet_obs")
    none = F.lit(None).cast("string")
    ts = F.timestamp_micros(F.lit(NOW_US))
    return events.build_event(
        df, index="bb-changes", kind="event", category="change", type_="IP_CHANGED", ts=ts,
        context={"program": {"id": none, "name": none}, "asset": {"id": F.col("asset_id").cast("string"), "value": F.lit("x")}},
        body={"asset": {"value": F.col("fingerprint")}, "change": {"previous": none, "current": F.when(F.col("k") % 2 == 0, F.col("ip"))}}, keep=["seq"],
    ).select("seq", "payload")
