"""HTTP probe records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import schemas as S
from palisade.functions.addresses import ip_text, with_ip_bits
from palisade.functions.common import opaque
from palisade.functions.targets import asset_type
from palisade.functions.technology import from_fingerprint, from_server_header, merge_technologies
from palisade.functions.urls import normalize_urls
from palisade.functions.values import duration_ms
from palisade.operators import enrich
from palisade.operators.scope import validate_output, with_decision
from palisade.plans.base import Observed, Stage, as_is, asset_rows, edge_rows, union
from palisade.sources.events import build_event
from palisade.sources.records import parse_jsonl


def normalize_records(lines: DataFrame) -> DataFrame:
    """lines: (program_id, job_id, observed_at, seq, value).  Adds ``malformed``, ``unusable`` and the observation fields;
    failed probes and records without URL are dropped."""
    df = parse_jsonl(lines, S.HTTP_RECORD)
    r = F.col("record")
    df = df.filter(r.isNull() | (~F.coalesce(r["failed"], F.lit(False)) & F.coalesce(r["url"] != "", F.lit(False))))
    df = normalize_urls(df.withColumn("__url", r["url"]), "__url", "u")
    df = with_ip_bits(df, F.coalesce(F.when(r["host_ip"] != "", r["host_ip"]), r["host"]), "ip_bits", collapse_mapped=False)
    fingerprints = F.transform(r["tech"], from_fingerprint)
    with_header = F.concat(
        F.coalesce(fingerprints, F.array().cast(_TECH)), F.array(F.when(r["webserver"] != "", from_server_header(r["webserver"]))).cast(_TECH)
    )
    df = opaque(df, __techs=with_header)
    df = opaque(df, technologies=F.when(r.isNotNull(), merge_technologies(F.col("__techs"))))
    return df.select(
        *[c for c in lines.columns if c != "value"], "malformed", (r.isNotNull() & F.col("u.error").isNotNull()).alias("unusable"),
        "u", F.col("u.value").alias("url"), ip_text(F.col("ip_bits")).alias("ip"), "ip_bits", r["status_code"].alias("status_code"),
        r["content_length"].alias("content_length"), r["content_type"].alias("content_type"), duration_ms(r["time"]).alias("time_ms"),
        r["title"].alias("title"), r["webserver"].alias("webserver"), r["location"].alias("location"),
        F.coalesce(r["cdn"], F.lit(False)).alias("cdn_detected"), r["cdn_name"].alias("cdn_name"), r["cdn_type"].alias("cdn_type"),
        r["favicon"].alias("favicon"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce(r["a"], _EMPTY()), F.coalesce(r["aaaa"], _EMPTY())))).alias("ips"),
        F.coalesce(r["cname"], _EMPTY()).alias("cname"), "technologies",
    )


_TECH = (
    "array<struct<name:string,vendor:string,product:string,version:string,confidence:double,version_confidence:double,"
    "source:string,raw:string>>"
)


def _EMPTY():
    return F.array().cast("array<string>")


def http_plan(lines: DataFrame, rules: DataFrame, cloud_ranges: DataFrame, asn_ranges: DataFrame, stage: Stage = as_is) -> Observed:
    """Normalise, validate (URL and, with a ``pinned`` column, the contacted address), enrich; then assets, edges, states
    (facet ``http:<origin>``, owned by the host when it has a name)."""
    rows = stage(normalize_records(lines))
    usable = rows.filter(F.col("url").isNotNull())
    pinned = ("ip", "pinned") if "pinned" in lines.columns else (None, None)
    checked = validate_output(usable, rules, "url", "program_id", *pinned)
    rich = stage(enrich.enrich_ips(checked, cloud_ranges, asn_ranges, "ip_bits", addresses=usable))
    ok = rich.filter(F.col("decision.allowed"))
    named = ok.filter(F.col("u.host_type") == "domain")
    host = F.col("u.host")
    addressed = named.filter(F.col("ip").isNotNull())
    techs = ok.select("*", F.explode("technologies").alias("t"))
    ip_kind = F.when(F.length("ip_bits") == 32, "ipv4").otherwise("ipv6")
    with_asn = addressed.filter(F.col("asn.number").isNotNull())
    as_name = F.concat(F.lit("AS"), F.col("asn.number").cast("string"))
    assets = union(
        asset_rows(ok, "url", F.col("url"), "httpx", "responded to HTTP probe"),
        asset_rows(named, asset_type(F.lit("domain"), host), host, "httpx", "HTTP host"),
        asset_rows(addressed, ip_kind, F.col("ip"), "httpx", F.concat(host, F.lit(" connected to "), F.col("ip"))),
        asset_rows(techs, "technology", F.col("t.name"), "httpx", F.concat(F.lit("fingerprinted by "), F.col("t.source"))),
        asset_rows(with_asn, "asn", as_name, "ipranges", "routing data"),
    )
    meta = F.to_json(F.struct(F.col("t.version").alias("version"), F.col("t.version_confidence").alias("version_confidence")))
    edges = union(
        edge_rows(named, host, F.col("url"), "HAS_URL", "httpx", 0.95),
        edge_rows(addressed, host, F.col("ip"), "RESOLVES_TO", "httpx", 0.95),
        edge_rows(techs, F.col("url"), F.col("t.name"), "USES_TECHNOLOGY", "httpx", F.col("t.confidence"), meta),
        edge_rows(with_asn, F.col("ip"), as_name, "BELONGS_TO_ASN", "iptoasn", 0.9),
    )
    state = F.struct(
        "status_code", "title", "webserver", F.transform("technologies", lambda t: t["name"]).alias("technologies"), "ip",
        F.col("cdn_name").alias("cdn"), F.col("asn.number").alias("asn"), F.col("cloud.provider").alias("cloud"),
        F.lit(True).alias("has_asn"), F.lit(True).alias("has_cloud"),
    )
    owner = F.when(F.col("u.host_type") == "domain", host).otherwise(F.col("url"))
    states = ok.select(
        owner.alias("asset_id"), F.concat(F.lit("http:"), F.col("u.origin")).alias("facet"), "observed_at", "seq", state.alias("current"),
        "program_id", "url",
    )
    stage_name = F.when(F.size("technologies") > 0, "TECH_IDENTIFIED").otherwise("HTTP_PROBED")
    scanned = ok.select(F.col("url").alias("asset_id"), F.col("observed_at").alias("scanned_at"), stage_name.alias("stage"), F.lit(True).alias("active"), "seq")
    return Observed(rich, assets, edges, states, {"scanned": scanned, "parsed": rows})


def http_events(rows: DataFrame) -> DataFrame:
    """HTTP_OBSERVATION events of accepted observations."""
    ok = rows.filter(F.col("decision.allowed"))
    u = F.col("u")
    return build_event(
        ok, index="bb-http", kind="event", category="web", type_="HTTP_OBSERVATION", ts=F.col("observed_at").cast("timestamp"),
        context={
            "program": {"id": F.col("program_id").cast("string")}, "asset": {"type": F.lit("url"), "value": F.col("url")},
            "scan": {"job_id": F.col("job_id").cast("string"), "tool": F.lit("httpx")}, "source": {"name": F.lit("httpx"), "type": F.lit("active")},
        },
        body={
            "url": {"full": F.col("url"), "domain": u["host"], "scheme": u["scheme"], "port": u["port"], "path": u["path"], "hash": u["url_hash"]},
            "http": {
                "response": F.struct("status_code", "content_length", "content_type", "time_ms"), "title": F.col("title"),
                "webserver": F.col("webserver"), "location": F.col("location"),
                "cdn": F.struct(F.col("cdn_detected").alias("detected"), F.col("cdn_name").alias("name"), F.col("cdn_type").alias("type")),
                "favicon": F.struct(F.col("favicon").alias("mmh3"), F.when(F.col("favicon").isNotNull(), 0.5).alias("confidence")),
            },
            "host": {"ip": F.col("ip"), "ips": F.col("ips")}, "dns": {"cname": F.col("cname")}, "network": {"port": u["port"]},
            "technology": F.col("technologies"), "cloud": F.col("cloud"), "asn": F.col("asn"),
        },
        keep=["seq"],
    )


def summary_rows(parsed: DataFrame, checked: DataFrame) -> DataFrame:
    """Input of ``aggregates.run_summary`` for a plan's parsed and checked rows."""
    bad = parsed.filter(F.col("malformed").isNotNull()).select("job_id", F.lit(True).alias("malformed"), F.lit(False).alias("allowed"))
    good = checked.select("job_id", F.lit(False).alias("malformed"), F.col("decision.allowed").alias("allowed"))
    return bad.unionByName(good).withColumn("severity", F.lit(None).cast("string"))


def link_decisions(states: DataFrame, rules: DataFrame) -> DataFrame:
    """Program membership rows of a plan's URL observations."""
    d = with_decision(states.select("program_id", "url", "observed_at", "seq"), rules, "url", "program_id")
    return d.select(
        "program_id", F.col("url").alias("asset_id"), F.col("decision.allowed").alias("allowed"), F.col("decision.match_kind").alias("match_kind"),
        F.col("decision.scope_id").alias("scope_id"), F.col("decision.reason").alias("reason"), F.col("observed_at").alias("seen_at"), "seq",
    )
