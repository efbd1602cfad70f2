"""TLS handshake records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import schemas as S
from palisade.functions.common import opaque, sorted_set
from palisade.functions.names import normalize_domains
from palisade.functions.targets import asset_type
from palisade.functions.values import days_until_expiry, expiry_status
from palisade.operators.scope import validate_output, with_decision
from palisade.plans.base import Observed, Stage, as_is, asset_rows, edge_rows, union
from palisade.sources.records import parse_jsonl


def normalize_records(lines: DataFrame, now: Column) -> DataFrame:
    """lines: (program_id, job_id, host, observed_at, seq, value); ``host`` is the scanned target.  Records of failed
    probes or without fingerprint are dropped."""
    df = parse_jsonl(lines, S.TLS_RECORD)
    r = F.col("record")
    usable = F.coalesce(r["probe_status"], F.lit(True)) & F.coalesce(r["fingerprint_hash"]["sha256"] != "", F.lit(False))
    df = df.filter(r.isNull() | usable)
    not_after = r["not_after"].try_cast("timestamp")
    return df.select(
        *[c for c in lines.columns if c != "value"], "malformed", r["fingerprint_hash"]["sha256"].alias("fingerprint"), r["ip"].alias("ip"),
        F.when(r["port"].rlike("^[0-9]{1,9}$"), r["port"].try_cast("int")).alias("port"), r["tls_version"].alias("tls_version"),
        r["cipher"].alias("cipher"), r["sni"].alias("sni"), r["subject_cn"].alias("cn"), r["subject_dn"].alias("subject"),
        sorted_set(F.transform(r["subject_an"], F.lower)).alias("san"), r["serial"].alias("serial"), r["issuer_dn"].alias("issuer"),
        r["issuer_cn"].alias("issuer_cn"), F.coalesce(r["issuer_org"], F.array().cast("array<string>")).alias("issuer_org"),
        r["not_before"].alias("not_before"), r["not_after"].alias("not_after"),
        *[F.coalesce(r[f], F.lit(False)).alias(f) for f in ("self_signed", "mismatched", "expired")],
        expiry_status(not_after, now).alias("expiry_status"), days_until_expiry(not_after, now).alias("days_until_expiry"),
    )


def tls_plan(lines: DataFrame, rules: DataFrame, now: Column, stage: Stage = as_is) -> Observed:
    """Validate host and contacted address; certificates and in-scope, non-wildcard SANs become assets."""
    rows = normalize_records(lines, now)
    pinned = ("ip", "pinned") if "pinned" in lines.columns else (None, None)
    checked = stage(validate_output(rows.filter(F.col("fingerprint").isNotNull()), rules, "host", "program_id", *pinned))
    ok = checked.filter(F.col("decision.allowed"))
    sans = ok.select("program_id", "fingerprint", "observed_at", "seq", F.explode("san").alias("san")).filter(~F.startswith("san", F.lit("*.")))
    sans = normalize_domains(sans, "san", "d").filter(F.col("d.value").isNotNull()).withColumn("san_name", F.col("d.value")).drop("d")
    approved = with_decision(sans, rules, "san_name", "program_id").filter(F.col("decision.allowed"))
    meta = F.to_json(F.struct("port", "ip"))
    assets = union(
        asset_rows(ok, asset_type(F.col("decision.kind"), F.col("decision.value")), F.col("decision.value"), "tlsx", "TLS endpoint"),
        asset_rows(ok, "certificate", F.col("fingerprint"), "tlsx", "certificate presented by approved host"),
        asset_rows(approved, asset_type(F.lit("domain"), F.col("san_name")), F.col("san_name"), "tlsx", F.concat(F.lit("certificate SAN matched "), F.col("decision.reason"))),
    )
    edges = union(
        edge_rows(ok, F.col("decision.value"), F.col("fingerprint"), "USES_CERTIFICATE", "tlsx", 0.95, meta),
        edge_rows(approved, F.col("san_name"), F.col("fingerprint"), "DISCOVERED_FROM", "tlsx", 0.7),
    )
    state = F.struct("fingerprint", "issuer", "san", "tls_version", "not_after", "expiry_status")
    states = ok.select(
        F.col("decision.value").alias("asset_id"), F.concat(F.lit("tls:"), F.coalesce(F.col("port").cast("string"), F.lit("None"))).alias("facet"),
        "observed_at", "seq", state.alias("current"), "program_id",
    )
    return Observed(checked, assets, edges, states, {"sans": approved, "parsed": opaque(rows, __p=F.lit(1)).drop("__p")})
