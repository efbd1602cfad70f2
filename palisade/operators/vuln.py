"""Versioned technologies joined with vulnerability feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.technology import confidence_level, with_cpe_candidate
from palisade.operators.skew import lookup_join


def tech_observations(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """USES_TECHNOLOGY edges with a reliable CPE candidate.

    edges: (source_id, target_id, relationship_type, confidence, version, version_confidence, cpe); assets: (asset_id,
    value).  Edge metadata is the first seen for the pair, so a later version of the same technology does not show."""
    uses = edges.filter(F.col("relationship_type") == "USES_TECHNOLOGY")
    named = lookup_join(
        uses, assets.select(F.col("asset_id").alias("target_id"), F.col("value").alias("technology")), ["target_id"], "inner",
        spread=["source_id"],
    )
    found = with_cpe_candidate(named, "technology", "version", "cpe").filter(F.col("candidate").isNotNull())
    return found.select(
        F.col("source_id").alias("asset_id"), "technology", "version", F.col("confidence").alias("technology_confidence"),
        "version_confidence", F.col("candidate.cpe").alias("cpe"), F.col("candidate.confidence").alias("cpe_confidence"),
        F.col("candidate.level").alias("cpe_level"),
    )


def cves_for_cpe(observations: DataFrame, lookups: DataFrame, now: Column, max_cpes: int | None = None) -> DataFrame:
    """Observations x vulnerabilities of their CPE from fresh lookups.

    ``max_cpes`` limits a run to the first CPEs in order, as a lookup budget.  lookups: (cpe, cve_ids, fetched_at)."""
    fresh = lookups.filter(
        F.col("fetched_at").cast("timestamp") > now.cast("timestamp") - F.make_interval(days=F.lit(K.CPE_LOOKUP_TTL_DAYS))
    )
    if max_cpes is not None:
        wanted = observations.select("cpe").distinct().orderBy("cpe").limit(max_cpes)
        fresh = fresh.join(F.broadcast(wanted), "cpe", "left_semi") if max_cpes <= 100_000 else fresh.join(wanted, "cpe", "left_semi")
    pairs = fresh.select("cpe", F.explode(F.array_distinct("cve_ids")).alias("cve_id"))
    return lookup_join(observations, pairs, ["cpe"], "inner", fanout=20)


def enrich_vuln(correlations: DataFrame, cves: DataFrame, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """Correlations with CVE record, EPSS score and live KEV entry side by side; no composite score is formed."""
    record = cves.select("cve_id", "description", "published", "cvss_score", "cvss_version", "cvss_vector", "cvss_severity")
    score = epss.select("cve_id", F.col("score").alias("epss_score"), F.col("percentile").alias("epss_percentile"))
    live = kev.filter(F.col("removed_at").isNull()) if "removed_at" in kev.columns else kev
    entry = live.select("cve_id", F.lit(True).alias("__kev"), F.col("vendor").alias("kev_vendor"), F.col("product").alias("kev_product"))
    out = correlations
    for side in (record, score, entry):
        out = lookup_join(out, side, ["cve_id"], "left")
    return out.withColumns(
        {"kev_in_catalog": F.coalesce("__kev", F.lit(False)), "cpe_confidence_level": F.when(F.col("cpe").isNotNull(), confidence_level(F.col("cpe_confidence")))}
    ).drop("__kev")


def asset_programs(rows: DataFrame, links: DataFrame, programs: DataFrame) -> DataFrame:
    """Fan rows out to the in-scope, not deleted programs of their asset; one row with a NULL program when none."""
    active = programs.filter(F.col("deleted_at").isNull()).select("program_id", F.col("name").alias("program_name"))
    side = lookup_join(links.filter(F.col("status") == "in_scope").select("asset_id", "program_id"), active, ["program_id"], "inner")
    return rows.join(side, "asset_id", "left")
