"""Certificate-transparency certificates x in-scope programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.targets import asset_type
from palisade.operators.merge import changed_assets
from palisade.operators.scope import evaluate_scope
from palisade.operators.skew import first_per_key
from palisade.plans.base import Observed, Stage, as_is, asset_rows, edge_rows, union
from palisade.sources.events import build_event


def match_certificates(certs: DataFrame, rules: DataFrame) -> DataFrame:
    """(certificate columns, domain, decision columns): one row per certificate name and program that allows it."""
    names = certs.select("*", F.explode("domains").alias("domain"))
    decided = evaluate_scope(names.select(F.col("domain").alias("target")), rules).filter("allowed")
    slim = decided.select(F.col("target").alias("domain"), "program_id", "program_name", "scope_id", "reason")
    return names.join(slim, "domain")


def ct_plan(certs: DataFrame, rules: DataFrame, *, keep_out_of_scope: bool = False, stage: Stage = as_is) -> Observed:
    """certs: output of ``parse_ct`` with observed_at and seq, duplicates already removed after matching (see
    ``streaming.dedupe``) or to be kept.  ``extra``: out_of_scope certificates when asked for, new_certificates."""
    rows = stage(match_certificates(certs, rules))
    extra = {}
    if keep_out_of_scope:
        extra["out_of_scope"] = certs.join(rows.select("fingerprint", "seq").distinct(), ["fingerprint", "seq"], "left_anti")
    return observed(rows, extra)


def observed(rows: DataFrame, extra: dict[str, DataFrame] | None = None) -> Observed:
    """Assets and edges of matched rows (certificate columns, domain, program and decision columns)."""
    assets = union(
        asset_rows(rows, "certificate", F.col("fingerprint"), "certstream", "certificate logged in Certificate Transparency"),
        asset_rows(rows, asset_type(F.lit("domain"), F.col("domain")), F.col("domain"), "certstream", F.concat(F.lit("certificate SAN matched "), "reason")),
    )
    edges = edge_rows(rows, F.col("domain"), F.col("fingerprint"), "DISCOVERED_FROM", "certstream", 0.7)
    return Observed(rows, assets, edges, extra=extra or {})


MATCH = "array<struct<domain:string,program_id:string,program_name:string,scope_id:string,reason:string>>"


def with_matches(certs: DataFrame, rules: DataFrame) -> DataFrame:
    """Certificate rows (fingerprint, observed_at, seq, ...) with ``matches``, the names and programs that allow them; empty where none does."""
    rows = match_certificates(certs, rules)
    found = rows.groupBy("fingerprint", "seq").agg(F.sort_array(F.collect_set(F.struct("domain", "program_id", "program_name", "scope_id", "reason"))).cast(MATCH).alias("matches"))
    return certs.join(found, ["fingerprint", "seq"], "left").withColumn("matches", F.coalesce("matches", F.array().cast(MATCH)))


def accepted_rows(accepted: DataFrame) -> DataFrame:
    """One row per accepted certificate message, name and program."""
    return accepted.select("*", F.explode("matches").alias("m")).select("*", "m.*").drop("m", "matches")


def link_rows(rows: DataFrame) -> DataFrame:
    """Program membership of the matched names; input of ``merge.link_assets``."""
    return rows.select(
        "program_id", F.col("domain").alias("asset_id"), F.lit(True).alias("allowed"), F.lit("include").alias("match_kind"), "scope_id", "reason",
        F.col("observed_at").alias("seen_at"), "seq")


def _context(**sections) -> dict:
    return {**sections, "source": {"name": F.lit("certstream"), "type": F.lit("passive")}, "scan": {"tool": F.lit("certstream")}}


def _body() -> dict:
    flags = F.col("flags")
    return {
        "tls": {
            "fingerprint": F.col("fingerprint"), "cn": F.col("subject_cn"), "san": F.concat("domains", "wildcards"), "serial": F.col("serial"), "subject": F.col("subject_dn"),
            "issuer": F.col("issuer_dn"), "issuer_cn": F.col("issuer_cn"), "issuer_org": F.array_compact(F.array("issuer_o")), "not_before": F.col("not_before"), "not_after": F.col("not_after"),
        },
        "certstream": {
            "source_url": F.col("source_url"), "source_name": F.col("source_name"), "cert_index": F.col("cert_index"), "seen": F.col("seen"), "update_type": F.col("update_type"),
            "sha1": F.col("sha1"), "sha256": F.col("sha256"), "flags": flags, "interesting": F.size(flags) > 0,
        },
    }


def certificate_events(rows: DataFrame) -> DataFrame:
    """A CT_CERTIFICATE event per accepted message, name and program."""
    kind = asset_type(F.lit("domain"), F.col("domain"))
    return build_event(
        rows, index="bb-certstream", kind="event", category="certificate", type_="CT_CERTIFICATE", ts=F.col("observed_at").cast("timestamp"),
        context=_context(program={"id": F.col("program_id"), "name": F.col("program_name")}, scope={"id": F.col("scope_id"), "status": F.lit("in")}, asset={"type": kind, "value": F.col("domain")}),
        body=_body(), keep=["seq"])


def outside_events(certs: DataFrame) -> DataFrame:
    """CT_CERTIFICATE events of certificates that no program allows, kept on request."""
    return build_event(
        certs, index="bb-certstream", kind="event", category="certificate", type_="CT_CERTIFICATE", ts=F.col("observed_at").cast("timestamp"),
        context=_context(scope={"status": F.lit("out")}), body=_body(), keep=["seq"])


def change_events(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """NEW_DOMAIN and NEW_SUBDOMAIN once per name that ``merged`` (result of ``merge.upsert_assets``) inserted, for the first program of the first message;
    NEW_CERTIFICATE for every program of the first message of an inserted certificate."""
    new = changed_assets(merged).filter(F.col("change_type").isin("NEW_DOMAIN", "NEW_SUBDOMAIN", "NEW_CERTIFICATE"))
    at = F.struct("observed_at", "seq")
    names = first_per_key(rows, ["domain"], [F.col("observed_at"), F.col("seq"), F.col("program_id")]).withColumn("value", F.col("domain"))
    names = names.join(new.filter("asset_type <> 'certificate'"), "value").withColumn("field", F.lit("tls.san"))
    certs = rows.join(rows.groupBy("fingerprint").agg(F.min(at).alias("__at")), "fingerprint").filter(at == F.col("__at")).drop("__at")
    certs = certs.dropDuplicates(["fingerprint", "program_id"]).withColumn("value", F.col("fingerprint")).withColumn("scope_id", F.lit(None).cast("string"))
    certs = certs.join(new.filter("asset_type = 'certificate'"), "value").withColumn("field", F.lit("tls.fingerprint"))
    named = F.col("asset_type") != "certificate"
    return build_event(
        names.unionByName(certs), index="bb-changes", kind="event", category="change", type_=F.col("change_type"), ts=F.col("observed_at").cast("timestamp"),
        context=_context(
            program={"id": F.col("program_id"), "name": F.col("program_name")}, scope={"id": F.col("scope_id"), "status": F.when(named, "in")},
            asset={"type": F.col("asset_type"), "value": F.col("value")}),
        body={"change": {"type": F.col("change_type"), "field": F.col("field"), "previous": F.col("previous"), "current": F.col("current")}, "confidence": {"score": F.lit(0.7)}},
        keep=["seq"])
