"""Crawler records: URL and endpoint inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import schemas as S
from palisade.functions.urls import endpoint_text, is_script_link, normalize_urls
from palisade.operators.aggregates import endpoint_inventory, url_inventory
from palisade.operators.scope import with_decision
from palisade.plans.base import Observed, Stage, as_is
from palisade.sources.records import parse_jsonl


def normalize_records(lines: DataFrame) -> DataFrame:
    """lines: (program_id, job_id, origin, observed_at, seq, value)."""
    df = parse_jsonl(lines, S.CRAWL_RECORD)
    r = F.col("record")
    req = r["request"]
    df = normalize_urls(df.withColumn("__url", req["endpoint"]), "__url", "u")
    return df.select(
        *[c for c in lines.columns if c != "value"], "malformed", (r.isNotNull() & F.col("u.error").isNotNull()).alias("unusable"), "u",
        F.col("u.value").alias("url"), F.col("u.url_hash").alias("url_hash"), F.col("u.endpoint_hash").alias("endpoint_hash"),
        endpoint_text(F.col("u")).alias("endpoint"), req["method"].alias("method"), req["source"].alias("parent"), req["tag"].alias("tag"),
        req["attribute"].alias("attribute"), is_script_link(req["tag"], req["source"]).alias("js_discovered"),
        r["response"]["status_code"].alias("status_code"),
    )


def crawl_plan(lines: DataFrame, rules: DataFrame, stage: Stage = as_is) -> Observed:
    """Validated URLs once per crawl, endpoints once per crawl, the refused URLs of each crawl.

    ``extra``: urls, endpoints, blocked (as alerts), parsed."""
    rows = normalize_records(lines)
    checked = stage(with_decision(rows.filter(F.col("url").isNotNull()), rules, "url", "program_id"))
    ok = checked.filter(F.col("decision.allowed"))
    urls = url_inventory(
        ok.select("job_id", "origin", "url_hash", "seq", "url", "endpoint_hash", "endpoint", "js_discovered", "status_code", "observed_at"), ["job_id"]
    )
    endpoints = endpoint_inventory(urls, ["job_id", "origin"])
    blocked = checked.filter(~F.col("decision.allowed"))
    return Observed(checked, extra={"urls": urls, "endpoints": endpoints, "blocked": blocked, "parsed": rows})
