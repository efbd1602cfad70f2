"""Template-scan findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import schemas as S
from palisade.functions.common import blank_to_null, opaque
from palisade.functions.urls import normalize_urls
from palisade.functions.values import sha256
from palisade.operators.scope import with_decision
from palisade.operators.skew import last_per_key
from palisade.plans.base import Observed, Stage, as_is
from palisade.sources.records import parse_jsonl


def _ids(c, prefix: str):
    kept = F.filter(F.transform(c, F.upper), lambda x: F.startswith(x, F.lit(prefix)))
    return F.coalesce(kept, F.array().cast("array<string>"))


def normalize_records(lines: DataFrame) -> DataFrame:
    """lines: (program_id, job_id, host, observed_at, seq, value).  A finding needs a template id and a matched URL."""
    df = parse_jsonl(lines, S.FINDING_RECORD)
    r, info = F.col("record"), F.col("record.info")
    cls = info["classification"]
    df = df.withColumn("__at", F.when(r["template-id"] != "", r["matched-at"]))
    df = normalize_urls(df, "__at", "u")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    out = opaque(
        df,
        url=F.col("u.value"), unusable=r.isNotNull() & F.col("u.value").isNull(), template_id=r["template-id"],
        template_path=blank_to_null(r["template-path"]), name=blank_to_null(info["name"]),
        severity=F.lower(F.coalesce(blank_to_null(info["severity"]), F.lit("unknown"))), target_host=blank_to_null(r["host"]), ip=r["ip"],
        tags=listed(info["tags"]), description=blank_to_null(info["description"]), reference=listed(info["reference"]),
        cves=_ids(cls["cve-id"], "CVE-"), cwes=_ids(cls["cwe-id"], "CWE-"), cvss_metrics=blank_to_null(cls["cvss-metrics"]),
        cvss_score=cls["cvss-score"], matcher_status=F.coalesce(r["matcher-status"], F.lit(False)),
        extracted_results=listed(r["extracted-results"]), curl_command=blank_to_null(r["curl-command"]),
    )
    return out.withColumn(
        "finding_hash", sha256(F.concat_ws("|", "template_id", "url"))
    ).drop("record", "value", "__at")


def findings_plan(lines: DataFrame, rules: DataFrame, stage: Stage = as_is) -> Observed:
    """Validated findings; members of the host state (the last record of equal findings counts) and detected CVE
    correlations.  ``extra``: members, correlations, blocked, parsed."""
    rows = normalize_records(lines)
    checked = stage(with_decision(rows.filter(F.col("url").isNotNull()), rules, "url", "program_id"))
    ok = checked.filter(F.col("decision.allowed"))
    members = last_per_key(
        ok.select("host", "job_id", "finding_hash", "severity", "template_id", "url", "seq"), ["host", "job_id", "finding_hash"], [F.col("seq")]
    )
    exploded = ok.select("job_id", F.col("host").alias("asset_id"), "seq", "observed_at", "template_id", "url", "finding_hash", F.posexplode("cves").alias("pos", "cve_id"))
    correlations = exploded.select(
        "asset_id", "cve_id", F.lit("nuclei").alias("source"), F.lit("detected").alias("status"), F.lit(None).cast("string").alias("technology"),
        F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("cpe"), F.lit(None).cast("double").alias("cpe_confidence"),
        F.col("observed_at").alias("seen_at"), "seq", "finding_hash",
    )
    blocked = checked.filter(~F.col("decision.allowed"))
    return Observed(checked, extra={"members": members, "correlations": correlations, "blocked": blocked, "parsed": rows})
