"""Scalar functions over host, URL, address and part columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import constants as K
from palisade.catalogue.registry import register
from palisade.catalogue.standins import NOW, NOW_US, dotted, spark_sql, standin, table
from palisade.functions import addresses, names, targets, technology, urls, values
from palisade.functions.common import list_text, shorten

# the text under test is built by the same expression in both engines; what it must become is stated only in the SQL
_DOMAIN_TEXT = (
    "CASE page_id % 8 WHEN 0 THEN upper(host) WHEN 1 THEN host || '.' WHEN 2 THEN '  ' || host || ' ' WHEN 3 THEN host || '..x' "
    "WHEN 4 THEN '-' || host WHEN 5 THEN 'localhost' WHEN 6 THEN host || ':443' ELSE host END"
)


@register("fn1_domain", f"""
    SELECT page_id, CASE WHEN page_id % 8 IN (0, 1, 2, 7) THEN host END AS value,
           CASE page_id % 8 WHEN 3 THEN 'empty_label' WHEN 4 THEN 'invalid_label' WHEN 5 THEN 'too_few_labels' WHEN 6 THEN 'invalid_characters' END AS error
    FROM (SELECT page_id, host, {_DOMAIN_TEXT} AS v FROM http_obs)""")
def fn1(spark, d):
    df = standin(spark, d, "http_obs").selectExpr("page_id", f"{_DOMAIN_TEXT} AS v")
    return names.normalize_domains(df, "v").select("page_id", "domain.value", "domain.error")


@register("fn2_registrable", """
    SELECT page_id, regexp_extract(host, '[^.]+[.][^.]+$') AS registrable, false AS is_suffix, true AS tld_is_suffix FROM http_obs""")
def fn2(spark, d):
    h = F.col("host")
    tld = F.substring_index(h, ".", -1)
    return standin(spark, d, "http_obs").select(
        "page_id", names.registrable_domain(h).alias("registrable"), names.is_public_suffix(h).alias("is_suffix"),
        names.is_public_suffix(tld).alias("tld_is_suffix"),
    )


_WILD_TEXT = "CASE page_id % 5 WHEN 0 THEN '*.' || upper(host) WHEN 1 THEN '*.co.uk' WHEN 2 THEN '*' || host WHEN 3 THEN '*.*.' || host ELSE '*.' || host END"


@register("fn3_wildcard", """
    SELECT page_id, CASE WHEN page_id % 5 IN (0, 4) THEN '*.' || host END AS value,
           CASE page_id % 5 WHEN 1 THEN 'public_suffix' WHEN 2 THEN 'not_a_wildcard' WHEN 3 THEN 'nested_wildcard' END AS error FROM http_obs""")
def fn3(spark, d):
    df = standin(spark, d, "http_obs").selectExpr("page_id", f"{_WILD_TEXT} AS v")
    return names.normalize_wildcards(df, "v").select("page_id", "wildcard.value", "wildcard.error")


_IP_TEXT = (
    "CASE ip_int % 6 WHEN 0 THEN '[' || ip || ']' WHEN 1 THEN '::ffff:' || ip WHEN 2 THEN ip || '%eth0' WHEN 3 THEN '0' || ip "
    "WHEN 4 THEN '2001:DB8:0:0:0:0:0:' || upper(HEX(ip_int % 65535 + 1)) ELSE ip END"
)


@register("fn4_ip", """
    SELECT ip_int, CASE WHEN ip_int % 6 IN (0, 1, 5) THEN ip WHEN ip_int % 6 = 4 THEN '2001:db8::' || HEX(ip_int % 65535 + 1) END AS value,
           CASE WHEN ip_int % 6 IN (0, 1, 5) THEN ip_bits
                WHEN ip_int % 6 = 4 THEN '00100000000000010000110110111000' || repeat('0', 80) || lpad(bin(ip_int % 65535 + 1), 16, '0') END AS bits,
           CASE ip_int % 6 WHEN 2 THEN 'zone_identifier' WHEN 3 THEN 'invalid_ip' END AS error FROM ips""")
def fn4(spark, d):
    df = standin(spark, d, "ips").selectExpr("ip_int", spark_sql(f"{_IP_TEXT} AS v"))
    return addresses.normalize_ips(df, "v").select("ip_int", "ip.value", "ip.bits", "ip.error")


_NET_TEXT = f"{dotted('lo')} || '/' || CAST(plen AS STRING)"


@register("fn5_cidr", f"""
    SELECT ip_int, plen, {_NET_TEXT.replace('STRING', 'VARCHAR')} AS masked, ip_int = lo AS strict_ok FROM nets""")
def fn5(spark, d):
    df = standin(spark, d, "nets").selectExpr("ip_int", "plen", f"{dotted('ip_int')} || '/' || CAST(plen AS STRING) AS v")
    df = addresses.normalize_cidrs(df, "v", "loose", strict=False)
    df = addresses.normalize_cidrs(df, "v", "strict", strict=True)
    return df.select("ip_int", "plen", F.col("loose.value").alias("masked"), F.col("strict.error").isNull().alias("strict_ok"))


_ASN_TEXT = "CASE s_suppkey % 4 WHEN 0 THEN 'AS' || CAST(s_suppkey AS STRING) WHEN 1 THEN 'as' || CAST(s_suppkey + 64500 AS STRING) WHEN 2 THEN 'ASX' ELSE '42949672960' END"


@register("fn6_asn", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey > 0 THEN s_suppkey WHEN s_suppkey % 4 = 1 THEN s_suppkey + 64500 END AS value,
           CASE WHEN s_suppkey = 0 THEN 'asn_out_of_range' WHEN s_suppkey % 4 = 2 THEN 'invalid_asn' WHEN s_suppkey % 4 = 3 THEN 'invalid_asn' END AS error FROM supplier""")
def fn6(spark, d):
    df = table(spark, d, "supplier").selectExpr("s_suppkey", f"{_ASN_TEXT} AS v")
    return targets.normalize_asns(df, "v").select("s_suppkey", "asn.value", "asn.error")


_URL_TEXT = (
    "CASE page_id % 6 WHEN 0 THEN 'HTTPS://' || upper(host) || ':443/a/./b/../' || CAST(page_id AS STRING) || '?z=1&a=' || CAST(page_id AS STRING) || '#f' "
    "WHEN 1 THEN 'http://' || host || ':8080' WHEN 2 THEN 'https://x@' || host || '/' WHEN 3 THEN 'ftp://' || host || '/' "
    "WHEN 4 THEN 'http://[2001:DB8::1]:8443/p%20q/..%2fr?b&a=%41+' ELSE url END"
)


@register("fn7_url", """
    SELECT page_id,
           CASE page_id % 6 WHEN 0 THEN 'https://' || host || '/a/' || CAST(page_id AS VARCHAR) || '?a=' || CAST(page_id AS VARCHAR) || '&z=1'
               WHEN 1 THEN 'http://' || host || ':8080/' WHEN 4 THEN 'http://[2001:db8::1]:8443/r?a=A+&b=' WHEN 5 THEN norm_url END AS value,
           CASE page_id % 6 WHEN 2 THEN 'userinfo' WHEN 3 THEN 'unsupported_scheme' END AS error,
           CASE page_id % 6 WHEN 0 THEN 443 WHEN 1 THEN 8080 WHEN 4 THEN 8443 WHEN 5 THEN CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END END AS port,
           CASE WHEN page_id % 6 IN (0, 1, 5) THEN host WHEN page_id % 6 = 4 THEN '2001:db8::1' END AS host
    FROM http_obs""")
def fn7(spark, d):
    df = standin(spark, d, "http_obs").selectExpr("page_id", f"{_URL_TEXT} AS v")
    return urls.normalize_urls(df, "v").select("page_id", "u.value", "u.error", "u.port", "u.host")


@register("fn8_hashes", """
    SELECT page_id, SHA(norm_url) AS url_hash,
           SHA(regexp_replace(norm_url, '[?].*$', '') || '|' || replace(regexp_replace(regexp_extract(norm_url, '[?](.*)$', 1), '=[^&]*', '', 'g'), '&', ',')) AS endpoint_hash,
           replace(regexp_replace(regexp_extract(norm_url, '[?](.*)$', 1), '=[^&]*', '', 'g'), '&', ',') AS parameters,
           regexp_extract(norm_url, '^https?://[^/]+') AS origin FROM http_obs""")
def fn8(spark, d):
    df = urls.normalize_urls(standin(spark, d, "http_obs").select("page_id", "url"), "url")
    return df.select("page_id", "u.url_hash", "u.endpoint_hash", F.array_join("u.parameters", ",").alias("parameters"), "u.origin")


_TARGET_TEXT = (
    "CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN 'AS' || CAST(page_id + 1 AS STRING) WHEN 2 THEN '10.' || CAST(page_id % 256 AS STRING) || '.0.0/16' "
    "WHEN 3 THEN host_ip WHEN 4 THEN '2001:DB8::' || CAST(page_id % 10 AS STRING) WHEN 5 THEN '*.' || host WHEN 6 THEN upper(host) || '.' "
    "WHEN 7 THEN '10.0.0.5/24' ELSE ' ' END"
)


@register("fn9_classify", """
    SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'url' WHEN 1 THEN 'asn' WHEN 2 THEN 'cidr' WHEN 3 THEN 'ipv4' WHEN 4 THEN 'ipv6' WHEN 5 THEN 'wildcard' WHEN 6 THEN 'domain' END AS kind,
           CASE page_id % 9 WHEN 0 THEN norm_url WHEN 1 THEN 'AS' || CAST(page_id + 1 AS VARCHAR) WHEN 2 THEN '10.' || CAST(page_id % 256 AS VARCHAR) || '.0.0/16'
               WHEN 3 THEN host_ip WHEN 4 THEN CASE WHEN page_id % 10 = 0 THEN '2001:db8::' ELSE '2001:db8::' || CAST(page_id % 10 AS VARCHAR) END
               WHEN 5 THEN '*.' || host WHEN 6 THEN host END AS value,
           CASE page_id % 9 WHEN 7 THEN 'host_bits_set' WHEN 8 THEN 'empty' END AS error FROM http_obs""")
def fn9(spark, d):
    df = standin(spark, d, "http_obs").selectExpr("page_id", f"{_TARGET_TEXT} AS v")
    return targets.classify(df, "v").select("page_id", "t.kind", "t.value", "t.error")


_SCOPE_TYPE = "CASE page_id % 5 WHEN 0 THEN 'domain' WHEN 1 THEN 'wildcard' WHEN 2 THEN 'ipv4' WHEN 3 THEN 'asn' ELSE 'domain' END"
_SCOPE_TEXT = "CASE page_id % 5 WHEN 0 THEN upper(host) WHEN 1 THEN '*.' || host WHEN 2 THEN host WHEN 3 THEN CAST(page_id + 1 AS STRING) ELSE '*.' || host END"


@register("fn10_scope_value", """
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN host WHEN 1 THEN '*.' || host WHEN 3 THEN 'AS' || CAST(page_id + 1 AS VARCHAR) END AS value,
           CASE WHEN page_id % 5 IN (2, 4) THEN 'type_mismatch' END AS error FROM http_obs""")
def fn10(spark, d):
    df = standin(spark, d, "http_obs").selectExpr("page_id", f"{_SCOPE_TYPE} AS type", f"{_SCOPE_TEXT} AS v")
    return targets.normalize_scope_values(df, "type", "v").select("page_id", "scope.value", "scope.error")


@register("fn11_asset_type", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'domain' WHEN page_id % 3 = 1 THEN 'subdomain' ELSE 'ipv4' END AS asset_type FROM http_obs""")
def fn11(spark, d):
    df = standin(spark, d, "http_obs").selectExpr(
        "page_id", "CASE page_id % 3 WHEN 0 THEN regexp_extract(host, '[^.]+[.][^.]+$', 0) WHEN 1 THEN host ELSE host_ip END AS v"
    )
    df = targets.classify(df, "v")
    return df.select("page_id", targets.asset_type(F.col("t.kind"), F.col("t.value")).alias("asset_type"))


@register("fn12_stable_hash", """
    SELECT seq, SHA('{"asn":' || CAST(asn AS VARCHAR) || ',"fingerprint":"' || fingerprint || '","ip":' || CASE WHEN k % 3 = 0 THEN 'null' ELSE '"' || ip || '"' END || '}') AS state_hash FROM facet_obs""")
def fn12(spark, d):
    df = standin(spark, d, "facet_obs")
    return df.select("seq", values.stable_hash(ip=F.when(F.col("k") % 3 != 0, F.col("ip")), asn=F.col("asn"), fingerprint=F.col("fingerprint")).alias("state_hash"))


def _ranges(column: str) -> str:
    import ipaddress

    within = lambda nets: " OR ".join(
        f"{column} BETWEEN {int(ipaddress.ip_network(n)[0])} AND {int(ipaddress.ip_network(n)[-1])}" for n in nets
    )
    return f"(({within(K.SENSITIVE_V4)}) AND NOT ({within(K.NOT_SENSITIVE_V4)}))"


@register("fn13_sensitive", f"SELECT ip_int, {_ranges('ip_int')} AS sensitive FROM ips")
def fn13(spark, d):
    return standin(spark, d, "ips").select("ip_int", addresses.is_sensitive(F.col("ip_bits")).alias("sensitive"))


@register("fn14_duration", """
    SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN CAST(event_id % 1000 AS DOUBLE) WHEN 1 THEN (event_id % 1000) / 1000 WHEN 2 THEN (event_id % 1000) * 1000.0 END, 6) AS ms FROM events""")
def fn14(spark, d):
    df = table(spark, d, "events").selectExpr(
        "event_id", "CAST(event_id % 1000 AS STRING) || CASE event_id % 4 WHEN 0 THEN 'ms' WHEN 1 THEN 'µs' WHEN 2 THEN 's' ELSE 'm' END AS v"
    )
    return df.select("event_id", F.round(values.duration_ms(F.col("v")), 6).alias("ms"))


@register("fn15_flags", """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'numeric' WHEN 1 THEN 'punycode' WHEN 2 THEN 'numeric,suspicious_tld' ELSE '' END AS flags FROM http_obs""")
def fn15(spark, d):
    h = F.col("host")
    made = (
        F.when(F.col("page_id") % 4 == 0, F.array(h, F.concat(F.lit("7"), h))).when(F.col("page_id") % 4 == 1, F.array(F.concat(F.lit("xn--a."), h)))
        .when(F.col("page_id") % 4 == 2, F.array(F.lit("shop.example.tk"), F.lit("*.1a.example.com"))).otherwise(F.array(h))
    )
    df = standin(spark, d, "http_obs").select("page_id", made.alias("names"))
    return df.select("page_id", F.array_join(names.certificate_flags(F.col("names")), ",").alias("flags"))


_NOT_AFTER = f"AT({NOW_US} + (page_id * 13 % 120 - 40) * 86400000000 + 3600000000)"


@register("fn16_expiry", """
    SELECT page_id, CASE WHEN page_id * 13 % 120 - 40 < 0 THEN 'expired' WHEN page_id * 13 % 120 - 40 < 30 THEN 'expiring' ELSE 'valid' END AS status,
           CAST(round(page_id * 13 % 120 - 40 + 1.0 / 24, 1) AS DOUBLE) AS days_left FROM http_obs""")
def fn16(spark, d):
    df = standin(spark, d, "http_obs").selectExpr("page_id", spark_sql(f"{_NOT_AFTER} AS not_after"))
    now = F.lit(NOW).cast("timestamp")
    return df.select("page_id", values.expiry_status(F.col("not_after"), now).alias("status"), values.days_until_expiry(F.col("not_after"), now).alias("days_left"))


_TECH_NAME = (
    "CASE p_partkey % 7 WHEN 0 THEN 'Nginx' WHEN 1 THEN '  Apache   HTTP Server ' WHEN 2 THEN 'Vue.js' WHEN 3 THEN 'My  Tool!! ' || p_type "
    "WHEN 4 THEN 'Microsoft-IIS' WHEN 5 THEN '!!' ELSE 'httpd' END"
)


@register("fn17_technology_name", """
    SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'nginx' WHEN 1 THEN 'apache-httpd' WHEN 2 THEN 'vue' WHEN 3 THEN 'my-tool-' || lower(replace(p_type, ' ', '-'))
           WHEN 4 THEN 'iis' WHEN 5 THEN '!!' ELSE 'apache-httpd' END AS name FROM part""")
def fn17(spark, d):
    df = table(spark, d, "part").selectExpr("p_partkey", f"{_TECH_NAME} AS v")
    return df.select("p_partkey", technology.canonical_name(F.col("v")).alias("name"))


@register("fn18_version", """
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1.2.' || CAST(p_size AS VARCHAR) WHEN 1 THEN '8' WHEN 2 THEN '2.0-rc1+b' END AS version FROM part""")
def fn18(spark, d):
    df = table(spark, d, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN ' v1.2.' || CAST(p_size AS STRING) WHEN 1 THEN '8' WHEN 2 THEN '2.0-rc1+b' WHEN 3 THEN 'latest' ELSE '' END AS v"
    )
    return df.select("p_partkey", technology.clean_version(F.col("v")).alias("version"))


@register("fn19_technologies", """
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'nginx' WHEN 1 THEN 'hsts' WHEN 2 THEN 'iis' WHEN 3 THEN 'acme-web' WHEN 4 THEN 'jquery' END AS name,
           CASE p_partkey % 6 WHEN 0 THEN 'f5' WHEN 2 THEN 'microsoft' WHEN 3 THEN 'acme' WHEN 4 THEN 'jquery' END AS vendor,
           CASE p_partkey % 6 WHEN 0 THEN 'nginx' WHEN 2 THEN 'internet_information_services' WHEN 3 THEN 'acme_web' WHEN 4 THEN 'jquery' END AS product,
           CASE p_partkey % 6 WHEN 0 THEN '1.' || CAST(p_size AS VARCHAR) WHEN 2 THEN '10.0' WHEN 3 THEN '2.' || CAST(p_size AS VARCHAR) END AS version,
           CAST(CASE p_partkey % 6 WHEN 0 THEN 0.8 WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 0.6 WHEN 4 THEN 0.6 END AS DOUBLE) AS confidence,
           CAST(CASE p_partkey % 6 WHEN 0 THEN 0.7 WHEN 2 THEN 0.8 WHEN 3 THEN 0.5 END AS DOUBLE) AS version_confidence FROM part""")
def fn19(spark, d):
    df = table(spark, d, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN 'Nginx:1.' || CAST(p_size AS STRING) WHEN 1 THEN 'HSTS' WHEN 2 THEN 'Microsoft-IIS/10.0 (x)' "
        "WHEN 3 THEN 'cpe:/a:acme:acme_web:2.' || CAST(p_size AS STRING) WHEN 4 THEN 'jQuery' ELSE '' END AS v"
    )
    kind, v = F.col("p_partkey") % 6, F.col("v")
    t = (
        F.when(kind < 2, technology.from_fingerprint(v)).when(kind == 2, technology.from_server_header(v))
        .when(kind > 2, technology.discovered_technology(v))
    )
    return df.withColumn("t", t).select("p_partkey", "t.name", "t.vendor", "t.product", "t.version", "t.confidence", "t.version_confidence")


@register("fn20_cpe", """
    SELECT asset_id, CASE WHEN version IS NULL THEN NULL WHEN technology = 'hsts' THEN NULL ELSE 'cpe:2.3:a:' ||
        CASE technology WHEN 'nginx' THEN 'f5:nginx' WHEN 'apache-httpd' THEN 'apache:http_server' WHEN 'php' THEN 'php:php' ELSE 'jquery:jquery' END
        || ':' || version || ':*:*:*:*:*:*:*' END AS cpe, CASE WHEN version IS NOT NULL THEN 'high' END AS level FROM tech_obs""")
def fn20(spark, d):
    df = technology.with_cpe_candidate(standin(spark, d, "tech_obs"), "technology", "version")
    return df.select("asset_id", "candidate.cpe", "candidate.level")


@register("fn21_confidence", """
    SELECT job_id, CAST(CASE scanner WHEN 'dns' THEN 0.95 WHEN 'httpx' THEN 0.95 WHEN 'tlsx' THEN 0.9 WHEN 'uncover' THEN 0.5 WHEN 'mapcidr' THEN 1.0
        WHEN 'katana' THEN 0.9 WHEN 'bbot' THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence, CAST(0.5 AS DOUBLE) AS other FROM jobs""")
def fn21(spark, d):
    return standin(spark, d, "jobs").select(
        "job_id", technology.source_confidence(F.col("scanner")).alias("confidence"), technology.source_confidence(F.col("worker_id")).alias("other")
    )


@register("fn22_change_text", """
    SELECT seq, CAST(asn AS VARCHAR) AS number_text, '[' || ip || ', ' || fingerprint || ']' AS list_text, '{"ip":"' || ip || '","k":' || CAST(k AS VARCHAR) || '}' AS object_text FROM facet_obs""")
def fn22(spark, d):
    df = standin(spark, d, "facet_obs")
    return df.select(
        "seq", values.text_value(F.col("asn"), "bigint").alias("number_text"), values.array_text(F.array("ip", "fingerprint")).alias("list_text"),
        values.text_value(F.struct("ip", "k"), "struct").alias("object_text"),
    )


@register("fn23_short", """
    SELECT page_id, CASE WHEN length(title) <= 20 THEN title ELSE substring(title, 1, 19) || '…' END AS short, host || ', ' || host_ip AS listed FROM http_obs""")
def fn23(spark, d):
    df = standin(spark, d, "http_obs")
    return df.select("page_id", shorten(F.col("title"), 20).alias("short"), list_text(F.array("host", "host_ip")).alias("listed"))


@register("fn24_cidr_size", "SELECT ip_int, plen, CAST(hi - lo + 1 AS DOUBLE) AS addresses, hi - lo + 1 > 256 AS over_limit FROM nets")
def fn24(spark, d):
    df = standin(spark, d, "nets").withColumns({"net_bits": F.expr("substring(lpad(bin(lo), 32, '0'), 1, CAST(plen AS INT))"), "ip_version": F.lit(4)})
    return addresses.with_cidr_size(df, "net_bits", "ip_version").select("ip_int", "plen", "addresses", "over_limit")
