"""Keyed merges: the next snapshot of a table from the current one and new observations.

New rows are aggregated by key first (combined before the shuffle), then a full outer join on the key applies one rule
per column.  The result is again one row per key, so merging the same observations twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.skew import first_per_key, last_per_key

FIRST, LAST, GREATEST, LEAST, KEEP = "first", "last", "greatest", "least", "keep"


def merge(cur: DataFrame, new: DataFrame, key: Sequence[str], rules: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Merge ``new`` into ``cur`` (one row per key) and add ``inserted``.

    Rules per column: ``first`` the stored value wins, ``last`` the newest row's value wins (also when NULL),
    ``greatest``/``least`` over both, ``keep`` only the stored value (new keys take their first row's).
    ``order`` ranks new rows of the same key and must be unique within it."""
    firsts = [c for c, r in rules.items() if r in (FIRST, KEEP)]
    lasts = [c for c, r in rules.items() if r == LAST]
    rank = F.struct(*order)
    aggs = [F.lit(True).alias("__new")]
    if firsts:
        aggs.append(F.min_by(F.struct(*firsts), rank).alias("__first"))
    if lasts:
        aggs.append(F.max_by(F.struct(*lasts), rank).alias("__last"))
    aggs += [F.max(c).alias(f"__g_{c}") for c, r in rules.items() if r == GREATEST]
    aggs += [F.min(c).alias(f"__l_{c}") for c, r in rules.items() if r == LEAST]
    fresh = new.groupBy(*key).agg(*aggs[1:]).withColumn("__new", F.lit(True))
    old = cur.select(*key, *[F.col(c).alias(f"__c_{c}") for c in rules]).withColumn("__old", F.lit(True))
    both = old.join(fresh, list(key), "full_outer")
    had, got = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    out = []
    for c, r in rules.items():
        stored = F.col(f"__c_{c}")
        if r in (FIRST, KEEP):
            value = F.when(had, stored).otherwise(F.col(f"__first.{c}"))
        elif r == LAST:
            value = F.when(got, F.col(f"__last.{c}")).otherwise(stored)
        elif r == GREATEST:
            value = F.greatest(stored, F.col(f"__g_{c}"))
        else:
            value = F.least(stored, F.col(f"__l_{c}"))
        out.append(value.alias(c))
    return both.select(*key, *out, (~had).alias("inserted"))


def upsert_assets(cur: DataFrame, obs: DataFrame) -> DataFrame:
    """Assets by (asset_type, value): ``last_seen`` grows, the confidence explanation is replaced only by a strictly
    higher one, everything else keeps its first value.

    obs: (asset_type, value, seen_at, confidence, source, reason, seq)."""
    first = F.struct("seen_at", "seq")
    # highest confidence; among equals the earliest
    explained = F.max_by(
        F.struct("confidence", "source", "reason"), F.struct(F.col("confidence"), -F.unix_micros(F.col("seen_at").cast("timestamp")), -F.col("seq"))
    )
    fresh = obs.groupBy("asset_type", "value").agg(
        F.min_by("seen_at", first).alias("__first_seen"), F.max("seen_at").alias("__last_seen"), explained.alias("__why")
    ).withColumn("__new", F.lit(True))
    both = cur.withColumn("__old", F.lit(True)).join(fresh, ["asset_type", "value"], "full_outer")
    had = F.col("__old").isNotNull()
    better = ~had | (F.coalesce(F.col("confidence_score"), F.lit(0.0)) < F.col("__why.confidence"))
    better = F.coalesce(better, F.lit(False))
    pick = lambda stored, field: F.when(better, F.col(f"__why.{field}")).otherwise(F.col(stored))
    kept = lambda c, start: F.when(had, F.col(c)).otherwise(start).alias(c)
    extra = [c for c in ("paused", "last_scanned", "last_changed", "tags") if c in cur.columns]
    defaults = {"paused": F.lit(False), "tags": F.array().cast("array<string>")}
    return both.select(
        "asset_type", "value", kept("status", F.lit("discovered")), kept("lifecycle_stage", F.lit("DISCOVERED")),
        kept("first_seen", F.col("__first_seen")), F.greatest("last_seen", "__last_seen").alias("last_seen"),
        pick("confidence_score", "confidence").alias("confidence_score"), pick("confidence_source", "source").alias("confidence_source"),
        pick("confidence_reason", "reason").alias("confidence_reason"),
        *[kept(c, defaults.get(c, F.lit(None))) for c in extra], (~had).alias("inserted"),
    )


def link_status(allowed: Column, match_kind: Column) -> Column:
    return F.when(allowed, "in_scope").when(match_kind == "explicit_exclusion", "excluded").otherwise("out_of_scope")


def link_assets(cur: DataFrame, decisions: DataFrame) -> DataFrame:
    """Program membership by (program_id, asset_id); the last decision wins.

    decisions: (program_id, asset_id, allowed, match_kind, scope_id, reason, seen_at, seq)."""
    new = decisions.select(
        "program_id", "asset_id", link_status(F.col("allowed"), F.col("match_kind")).alias("status"), "scope_id",
        F.col("reason").alias("scope_reason"), F.col("seen_at").alias("first_seen"),
        F.col("seen_at").alias("last_seen"), "seq",
    )
    rules = {"status": LAST, "scope_id": LAST, "scope_reason": LAST, "first_seen": FIRST, "last_seen": GREATEST}
    return merge(cur, new.withColumn("seen_at", F.col("last_seen")), ["program_id", "asset_id"], rules, ["seen_at", "seq"])


EDGE_KEY = ["source_id", "target_id", "relationship_type"]


def upsert_edges(cur: DataFrame, obs: DataFrame) -> DataFrame:
    """Edges: only ``last_seen`` moves; source, confidence and metadata keep the first observation's.

    obs: (source_id, target_id, relationship_type, source, confidence, metadata, seen_at, seq)."""
    new = obs.withColumns({"first_seen": F.col("seen_at"), "last_seen": F.col("seen_at")})
    rules = {"source": FIRST, "confidence": FIRST, "metadata": FIRST, "first_seen": FIRST, "last_seen": GREATEST}
    return merge(cur, new, EDGE_KEY, rules, ["seen_at", "seq"])


def swap_state(cur: DataFrame, obs: DataFrame, value: str = "state") -> DataFrame:
    """Last state per (asset_id, facet) with the one it replaced in ``previous``.

    obs: (asset_id, facet, state, observed_at, seq); of several observations of a key in one batch the last is
    stored and the one before it is its previous state."""
    old = cur.select("asset_id", "facet", value, "observed_at", F.lit(-1).cast("long").alias("seq"))
    rows = old.unionByName(obs.select("asset_id", "facet", value, "observed_at", F.col("seq").cast("long").alias("seq")))
    # the two newest rows of each key, by two aggregations that combine before the shuffle
    rank = F.struct("observed_at", "seq")
    top = rows.groupBy("asset_id", "facet").agg(F.max(rank).alias("__top"))
    newest = last_per_key(rows, ["asset_id", "facet"], [F.col("observed_at"), F.col("seq")])
    below = rows.join(top, ["asset_id", "facet"]).filter(rank < F.col("__top"))
    second = below.groupBy("asset_id", "facet").agg(F.max_by(F.struct(value), rank).alias("__prev"))
    return newest.join(second, ["asset_id", "facet"], "left").select(
        "asset_id", "facet", value, "observed_at", F.col(f"__prev.{value}").alias("previous"),
        F.col("__prev").isNull().alias("inserted"),
    )


def mark_scanned(cur: DataFrame, obs: DataFrame) -> DataFrame:
    """Lifecycle columns of assets after scans.

    obs: (asset_id, scanned_at, stage, changed, active, seq).  ``active`` true activates; false deactivates only
    discovered or active assets; NULL leaves the status.  Outcomes are applied in order, which comes down to the last
    ``true``/``false`` and the last stage."""
    rank = F.struct("scanned_at", "seq")
    agg = obs.groupBy("asset_id").agg(
        F.max("scanned_at").alias("__at"), F.max(F.when(F.col("changed"), F.col("scanned_at"))).alias("__changed"),
        F.max_by("stage", F.when(F.col("stage").isNotNull(), rank)).alias("__stage"),
        F.max_by("active", F.when(F.col("active").isNotNull(), rank)).alias("__active"),
        F.max("active").alias("__any_active"),
    )
    out = cur.join(agg, "asset_id", "left")
    # a 'true' earlier in the batch makes a later 'false' effective, whatever the stored status
    soft = F.col("status").isin("discovered", "active") | F.coalesce(F.col("__any_active"), F.lit(False))
    status = F.when(F.col("__active"), "active").when(~F.col("__active") & soft, "inactive").otherwise(F.col("status"))
    return out.withColumns(
        {
            "status": status,
            "lifecycle_stage": F.coalesce("__stage", "lifecycle_stage"),
            "last_scanned": F.greatest("__at", "last_scanned"),
            "last_changed": F.greatest("__changed", "last_changed"),
            "last_seen": F.greatest("__at", "last_seen"),
        }
    ).drop("__at", "__changed", "__stage", "__active", "__any_active")


def upsert_correlations(cur: DataFrame, new: DataFrame, kev: DataFrame) -> DataFrame:
    """Asset-vulnerability correlations by (asset_id, cve_id, source).

    ``last_seen, status, version, cpe`` and the KEV flag are overwritten, the other columns keep their first value;
    ``was_kev`` is the flag before the merge (false for new rows).
    new: (asset_id, cve_id, source, status, technology, version, cpe, cpe_confidence, seen_at, seq); kev: live (cve_id)."""
    key = ["asset_id", "cve_id", "source"]
    live = kev.select("cve_id").distinct().withColumn("__kev", F.lit(True))
    flagged = new.join(live, "cve_id", "left").withColumns(
        {"in_kev": F.coalesce("__kev", F.lit(False)), "first_seen": F.col("seen_at"), "last_seen": F.col("seen_at")}
    )
    rules = {
        "status": LAST, "technology": FIRST, "version": LAST, "cpe": LAST, "cpe_confidence": FIRST, "in_kev": LAST,
        "first_seen": FIRST, "last_seen": GREATEST,
    }
    merged = merge(cur, flagged, key, rules, ["seen_at", "seq"])
    before = cur.select(*key, F.col("in_kev").alias("__was"))
    return merged.join(before, key, "left").withColumn("was_kev", F.coalesce("__was", F.lit(False))).drop("__was")


def upsert_last(cur: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Plain upsert: every non-key column takes the newest row's value (CVE records, CPE lookups, scores)."""
    rules = {c: LAST for c in cur.columns if c not in key}
    return merge(cur, new, key, rules, order)


def add_scope(cur: DataFrame, new: DataFrame) -> DataFrame:
    """Scope entries by (program_id, type, value, mode): new keys are inserted, inactive ones reactivated under the new
    source, active ones reported as conflicts.  ``outcome``: inserted, reactivated, conflict or unchanged.

    cur: key columns, source, active; new: key columns, source, seq."""
    key = ["program_id", "type", "value", "mode"]
    first = first_per_key(new.select(*key, "source", "seq"), key, [F.col("seq")])
    fresh = first.select(*key, F.col("source").alias("__source"), F.lit(True).alias("__new"))
    old = cur.select(*key, "source", "active").withColumn("__old", F.lit(True))
    both = old.join(fresh, key, "full_outer")
    had, got = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    outcome = (
        F.when(~had, "inserted").when(got & ~F.col("active"), "reactivated").when(got, "conflict").otherwise("unchanged")
    )
    takes = ~had | (got & ~F.col("active"))
    return both.select(
        *key, F.when(takes, F.col("__source")).otherwise(F.col("source")).alias("source"),
        (takes | F.coalesce("active", F.lit(False))).alias("active"), outcome.alias("outcome"),
    )


def changed_assets(merged: DataFrame) -> DataFrame:
    """NEW_* change rows of freshly inserted assets, by asset type."""
    kind = (
        F.when(F.col("asset_type") == "domain", "NEW_DOMAIN").when(F.col("asset_type") == "subdomain", "NEW_SUBDOMAIN")
        .when(F.col("asset_type").isin("ipv4", "ipv6"), "NEW_IP").when(F.col("asset_type") == "url", "NEW_URL")
        .when(F.col("asset_type") == "certificate", "NEW_CERTIFICATE").otherwise("NEW_ASSET")
    )
    return merged.filter(F.col("inserted")).select(
        "asset_type", "value", kind.alias("change_type"), F.lit(None).cast("string").alias("previous"), F.col("value").alias("current")
    )


