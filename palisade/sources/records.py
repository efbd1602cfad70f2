"""JSON-lines tool output and plain-text lists.

Readers take a DataFrame with one text line per row (column ``value``), as ``spark.read.text`` or a text stream gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade import schemas as S
from palisade.functions.addresses import ip_text, normalize_cidrs, with_ip_bits
from palisade.functions.common import opaque, strip
from palisade.functions.targets import classify


def parse_jsonl(lines: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """Add ``record`` (struct) and ``malformed`` (the line, cut) to each non-blank line; exactly one is non-null.

    Only JSON objects are records; arrays, scalars and broken JSON are malformed."""
    df = lines.withColumn("__line", strip(F.col(col))).filter(F.col("__line") != "")
    parsed = F.from_json("__line", schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    df = opaque(df, __rec=parsed)
    ok = F.startswith(F.col("__line"), F.lit("{")) & F.col("__rec").isNotNull() & F.col("__rec.__bad").isNull()
    ok = F.coalesce(ok, F.lit(False))
    return df.withColumns(
        {
            "record": F.when(ok, F.col("__rec").dropFields("__bad")),
            "malformed": F.when(~ok, F.col("__line")),
        }
    ).drop("__line", "__rec")


def read_jsonl(lines: DataFrame, schema: str, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines)."""
    both = parse_jsonl(lines, schema, col)
    return both.filter(F.col("record").isNotNull()).drop("malformed"), both.filter(F.col("malformed").isNotNull()).drop("record")


def _entries(lines: DataFrame, col: str) -> DataFrame:
    df = lines.withColumn("raw", strip(F.col(col)))
    return df.filter((F.col("raw") != "") & ~F.startswith(F.col("raw"), F.lit("#"))).select("raw").distinct()


def parse_domain_list(lines: DataFrame, col: str = "value", *, idn: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries(value, type), rejected(raw, error)) of a list of names, wildcards and addresses with '#' comments."""
    df = classify(_entries(lines, col), "raw", "t", idn=idn)
    accepted = F.col("t.kind").isin("domain", "wildcard", "ipv4", "ipv6")
    good = df.filter(accepted).select(F.col("t.value").alias("value"), F.col("t.kind").alias("type")).distinct()
    bad = df.filter(~F.coalesce(accepted, F.lit(False))).select(
        "raw", F.coalesce(F.col("t.error"), F.lit("unsupported_entry")).alias("error")
    )
    return good, bad


def parse_cidr_list(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(networks(cidr, ip_version, net_bits), rejected(raw, error)); host bits are masked."""
    df = normalize_cidrs(_entries(lines, col), "raw", "n", strict=False)
    good = df.filter(F.col("n.value").isNotNull()).select(
        F.col("n.value").alias("cidr"), F.col("n.version").alias("ip_version"), F.col("n.bits").alias("net_bits")
    )
    return good.distinct(), df.filter(F.col("n.value").isNull()).select("raw", F.col("n.error").alias("error"))


def parse_asn_tsv(lines: DataFrame, col: str = "value") -> DataFrame:
    """(start_ip, end_ip, start_bits, end_bits, ip_version, asn, country, organization) of routed, well-formed ranges."""
    parts = F.split(F.col(col), "\t", -1)
    df = lines.select(parts.alias("p")).filter(F.size("p") >= 5)
    at = lambda i: F.get(F.col("p"), F.lit(i))
    df = df.select(
        at(0).alias("s"), at(1).alias("e"), F.trim(at(2)).try_cast("long").alias("asn"),
        F.when(~at(3).isin("", "None"), at(3)).alias("country"),
        F.when(at(4) != "", at(4)).alias("organization"),
    )
    df = with_ip_bits(df, F.col("s"), "start_bits", collapse_mapped=False)
    df = with_ip_bits(df, F.col("e"), "end_bits", collapse_mapped=False)
    same = F.length("start_bits") == F.length("end_bits")
    df = df.filter((F.col("asn") > 0) & same & (F.col("end_bits") >= F.col("start_bits")))
    return df.select(
        ip_text(F.col("start_bits")).alias("start_ip"), ip_text(F.col("end_bits")).alias("end_ip"), "start_bits", "end_bits",
        F.when(F.length("start_bits") == 32, 4).otherwise(6).alias("ip_version"), "asn", "country", "organization",
    )


def parse_epss(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(scores(cve_id, score, percentile), meta(model_version, score_date)) of a scores CSV with a '#' header line."""
    text = F.col(col)
    pattern = r"model_version:([^,]+),score_date:([0-9]{4}-[0-9]{2}-[0-9]{2})"
    meta = lines.filter(F.startswith(text, F.lit("#")) & text.rlike(pattern)).agg(
        F.max(F.regexp_extract(text, pattern, 1)).alias("model_version"),
        F.max(F.regexp_extract(text, pattern, 2).try_cast("date")).alias("score_date"),
    )
    p = F.split(text, ",", -1)
    at = lambda i: F.get(p, F.lit(i))
    df = lines.filter(~F.startswith(text, F.lit("#"))).select(
        F.upper(strip(at(0))).alias("cve_id"), at(1).try_cast("double").alias("score"), at(2).try_cast("double").alias("percentile")
    )
    scores = df.filter(
        F.startswith(F.col("cve_id"), F.lit("CVE-")) & F.col("score").between(0, 1) & F.col("percentile").between(0, 1)
    )
    return scores, meta


def parse_kev(docs: DataFrame, col: str = "value", order: str | None = None) -> DataFrame:
    """One row per catalogued CVE; of duplicate ids the last counts: by document in ``order``, then by position; beyond that by content."""
    doc = docs.select(F.from_json(col, S.KEV_CATALOG).alias("d"), (F.col(order) if order else F.lit(0)).alias("__order"))
    rows = doc.select("__order", F.col("d.catalogVersion").alias("catalog_version"), F.posexplode("d.vulnerabilities").alias("pos", "v"))
    v = F.col("v")
    flat = rows.select(
        F.upper(strip(v["cveID"])).alias("cve_id"), "__order", "pos", "catalog_version", v["vendorProject"].alias("vendor"),
        v["product"].alias("product"), v["vulnerabilityName"].alias("vulnerability_name"),
        v["shortDescription"].alias("short_description"), v["dateAdded"].try_cast("date").alias("date_added"),
        v["dueDate"].try_cast("date").alias("due_date"), v["knownRansomwareCampaignUse"].alias("known_ransomware_use"),
        v["requiredAction"].alias("required_action"), v["notes"].alias("notes"),
        F.coalesce(v["cwes"], F.array().cast("array<string>")).alias("cwes"),
    ).filter(F.startswith(F.col("cve_id"), F.lit("CVE-")))
    kept = [c for c in flat.columns if c not in ("cve_id", "__order", "pos")]
    last = F.max_by(F.struct(*kept), F.struct("__order", "pos", F.xxhash64(*kept)))
    return flat.groupBy("cve_id").agg(last.alias("k")).select("cve_id", "k.*")


def parse_cve(docs: DataFrame, col: str = "value") -> DataFrame:
    """One row per CVE document: English text, the newest CVSS version with its primary metric, sorted CWE ids."""
    df = opaque(docs, c=F.from_json(col, S.CVE_RECORD)).filter(F.col("c.id").isNotNull())
    c = F.col("c")
    picks = []
    for key, version in (("cvssMetricV40", "4.0"), ("cvssMetricV31", "3.1"), ("cvssMetricV30", "3.0"), ("cvssMetricV2", "2.0")):
        items = c["metrics"][key]
        chosen = F.coalesce(F.get(F.filter(items, lambda m: m["type"] == "Primary"), F.lit(0)), F.get(items, F.lit(0)))
        picks.append(F.when(F.size(items) > 0, F.struct(F.lit(version).alias("version"), chosen.alias("m"))))
    df = opaque(df, p=F.coalesce(*picks))
    m = F.col("p.m")
    cwe = F.flatten(F.transform(c["weaknesses"], lambda w: F.transform(w["description"], lambda d: d["value"])))
    return df.select(
        c["id"].alias("cve_id"),
        F.get(F.filter(c["descriptions"], lambda d: d["lang"] == "en"), F.lit(0))["value"].alias("description"),
        c["published"].try_cast("timestamp").alias("published"), c["lastModified"].try_cast("timestamp").alias("last_modified"),
        c["vulnStatus"].alias("vuln_status"), m["cvssData"]["baseScore"].alias("cvss_score"),
        F.col("p.version").alias("cvss_version"), m["cvssData"]["vectorString"].alias("cvss_vector"),
        F.coalesce(m["cvssData"]["baseSeverity"], m["baseSeverity"]).alias("cvss_severity"),
        F.array_sort(F.array_distinct(F.filter(
            F.coalesce(cwe, F.array().cast("array<string>")), lambda x: F.startswith(x, F.lit("CWE-"))
        ))).alias("cwes"),
    )


def import_findings(lines: DataFrame, *, program: str | None = None, tool_version: str = "unknown", col: str = "value") -> DataFrame:
    """Findings of an external template scan as event documents (column ``payload``); NULL fields are left out."""
    rec, _ = read_jsonl(lines, S.FINDING_RECORD, col)
    r, info = F.col("record"), F.col("record.info")
    empty = F.array().cast("array<string>")
    where = F.coalesce(r["matched-at"], r["host"])
    event = F.struct(
        r["timestamp"].alias("@timestamp"),
        F.struct(*[F.lit(v).alias(k) for k, v in (("kind", "event"), ("category", "vulnerability"), ("type", "NUCLEI_FINDING"), ("action", "NUCLEI_FINDING"))]).alias("event"),
        F.struct(F.lit("bb-nuclei").alias("index"), F.lit(K.SCHEMA_VERSION).alias("schema_version")).alias("bb"),
        F.struct(F.lit("nuclei-external").alias("name"), F.lit("active").alias("type")).alias("source"),
        F.struct(F.lit("nuclei").alias("tool"), F.lit(tool_version).alias("tool_version")).alias("scan"),
        F.struct(F.lit("url").alias("type"), where.alias("value")).alias("asset"),
        F.struct(r["ip"].alias("ip")).alias("host"),
        F.struct(
            r["template-id"].alias("template_id"), info["name"].alias("template_name"), r["template-path"].alias("template_path"),
            F.coalesce(info["severity"], F.lit("unknown")).alias("severity"), r["type"].alias("type"),
            r["matched-at"].alias("matched_at"), r["matched-at"].alias("url"), r["host"].alias("host"), r["ip"].alias("ip"),
            r["matcher-name"].alias("matcher"), r["matcher-status"].alias("matcher_status"),
            r["extracted-results"].alias("extracted_results"), F.coalesce(info["tags"], empty).alias("tags"),
            info["description"].alias("description"), F.coalesce(info["reference"], empty).alias("reference"),
            F.coalesce(info["classification"]["cve-id"], empty).alias("cve_ids"),
            F.coalesce(info["classification"]["cwe-id"], empty).alias("cwe_ids"), r["curl-command"].alias("curl_command"),
        ).alias("nuclei"),
        *([F.struct(F.lit(program).alias("name")).alias("program")] if program else []),
    )
    keep = [c for c in lines.columns if c != col]
    return rec.select(
        *keep, r["template-id"].alias("template_id"), where.alias("asset_value"),
        F.coalesce(info["severity"], F.lit("unknown")).alias("severity"), F.to_json(event).alias("payload"),
    )
