"""The vulnerability correlation run: observations -> CVEs -> merged correlations -> changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.values import content_id
from palisade.operators import changes, merge, vuln
from palisade.plans.base import Observed, Stage, as_is
from palisade.sources.events import build_event


def correlation_plan(
    edges: DataFrame, assets: DataFrame, lookups: DataFrame, cves: DataFrame, epss: DataFrame, kev: DataFrame, links: DataFrame,
    programs: DataFrame, current: DataFrame, now: Column, max_cpes: int | None = None, stage: Stage = as_is,
) -> Observed:
    """``rows``: merged correlations enriched with feeds; ``extra``: observations, correlations (new pairs), changes."""
    observations = vuln.tech_observations(edges, assets)
    pairs = vuln.cves_for_cpe(observations, lookups, now, max_cpes)
    new = pairs.select(
        "asset_id", "cve_id", F.lit("cpe-correlation").alias("source"), F.lit("potential").alias("status"), "technology", "version", "cpe",
        "cpe_confidence", now.cast("timestamp").alias("seen_at"), F.xxhash64("technology", "cpe").alias("seq"),
    )
    live = kev.filter(F.col("removed_at").isNull())
    merged = stage(merge.upsert_correlations(current, new, live))
    rich = vuln.enrich_vuln(merged, cves, epss, kev)
    member_of = vuln.asset_programs(merged.select("asset_id").distinct(), links, programs).select("asset_id", "program_id").filter(F.col("program_id").isNotNull())
    touched = merged.filter(F.col("last_seen") == now.cast("timestamp"))
    return Observed(rich, extra={
        "observations": observations, "correlations": new, "merged": merged,
        "changes": changes.vulnerability_changes(touched, member_of),
    })


def correlation_events(rows: DataFrame, links: DataFrame, programs: DataFrame) -> DataFrame:
    """Current-state documents, one per asset, CVE, source and program."""
    wide = vuln.asset_programs(rows, links, programs)
    c = F.col
    return build_event(
        wide, index="bb-cve", kind="state", category="vulnerability", type_="CVE_CORRELATION", ts=c("last_seen").cast("timestamp"),
        doc_id=content_id(c("asset_id").cast("string"), c("cve_id"), c("source"), F.coalesce(c("program_id").cast("string"), F.lit("None"))),
        context={
            "program": {"id": c("program_id").cast("string"), "name": c("program_name")}, "asset": {"id": c("asset_id").cast("string")},
            "source": {"name": c("source"), "type": F.lit("correlation")},
        },
        body={
            "cve": {"id": c("cve_id"), "description": c("description"), "cpe": c("cpe"), "cpe_confidence": c("cpe_confidence"),
                    "cpe_confidence_level": c("cpe_confidence_level"), "status": c("status"), "source": c("source")},
            "cvss": {"score": c("cvss_score"), "version": c("cvss_version"), "vector": c("cvss_vector"), "severity": c("cvss_severity")},
            "epss": {"score": c("epss_score"), "percentile": c("epss_percentile")},
            "kev": {"in_catalog": c("kev_in_catalog"), "vendor": c("kev_vendor"), "product": c("kev_product")},
            "technology": {"name": c("technology"), "version": c("version")}, "vulnerability": {"status": c("status"), "source": c("source")},
        },
        keep=["asset_id", "cve_id"],
    )
