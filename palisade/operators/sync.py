"""Snapshot comparison: imports with history, provider ranges, the known-exploited catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.values import stable_hash


def snapshot_diff(previous: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, status): added, removed or unchanged.  ``previous`` holds the live keys."""
    p = previous.select(*key).distinct().withColumn("__p", F.lit(True))
    c = current.select(*key).distinct().withColumn("__c", F.lit(True))
    status = F.when(F.col("__p").isNull(), "added").when(F.col("__c").isNull(), "removed").otherwise("unchanged")
    return p.join(c, list(key), "full_outer").select(*key, status.alias("status"))


def target_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """(target, seq) of two target lists without repeats, each target at its first place: all of ``first``, then
    ``second``."""
    both = first.select("target", F.lit(0).alias("part"), "seq").unionByName(second.select("target", F.lit(1).alias("part"), "seq"))
    at = both.groupBy("target").agg(F.min(F.struct("part", "seq")).alias("at"))
    return at.select("target", F.col("at.part").alias("part"), F.col("at.seq").alias("seq"))


def import_scope(records: DataFrame, entries: DataFrame, now: Column, *, same_file: bool = False) -> DataFrame:
    """Next state of an import's source records.

    records: (value, type, first_seen, last_seen, removed_at); entries: (value, type) from ``parse_domain_list``.
    ``status`` says what happened: added (also when it came back), removed, unchanged, absent (gone before).  Scope
    entries follow ``scope_active``.  With ``same_file`` (equal content hash) live records are only touched."""
    old = records.withColumn("__old", F.lit(True))
    if same_file:
        live = F.col("removed_at").isNull()
        return records.withColumns(
            {"last_seen": F.when(live, now).otherwise(F.col("last_seen")), "scope_active": live,
             "status": F.when(live, "unchanged").otherwise("absent")}
        )
    new = entries.select("value", F.col("type").alias("__type")).distinct()
    both = old.join(new.withColumn("__new", F.lit(True)), "value", "full_outer")
    live = F.col("__old").isNotNull() & F.col("removed_at").isNull()
    got = F.col("__new").isNotNull()
    status = F.when(got & ~live, "added").when(~got & live, "removed").when(got, "unchanged").otherwise("absent")
    return both.select(
        "value", F.coalesce("__type", "type").alias("type"), F.coalesce("first_seen", now).alias("first_seen"),
        F.when(got, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(got, F.lit(None)).when(live, now).otherwise(F.col("removed_at")).alias("removed_at"),
        got.alias("scope_active"), status.alias("status"),
    )


def sync_ranges(previous: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """Next state of provider ranges, per provider: added (new or restored), removed, unchanged (touched), absent.

    previous: (provider, cidr, first_seen, last_seen, removed_at); current: (provider, cidr)."""
    key = ["provider", "cidr"]
    new = current.select(*key).distinct().withColumn("__new", F.lit(True))
    both = previous.withColumn("__old", F.lit(True)).join(new, key, "full_outer")
    live = F.col("__old").isNotNull() & F.col("removed_at").isNull()
    got = F.col("__new").isNotNull()
    status = F.when(got & ~live, "added").when(~got & live, "removed").when(got, "unchanged").otherwise("absent")
    return both.select(
        *key, F.coalesce("first_seen", now).alias("first_seen"), F.when(got, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(got, F.lit(None)).when(live, now).otherwise(F.col("removed_at")).alias("removed_at"), status.alias("status"),
    )


def sync_stats(synced: DataFrame, keys: Sequence[str]) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return synced.groupBy(*keys).agg(count("added"), count("removed"), count("unchanged"))


KEV_FIELDS = (
    "vendor", "product", "vulnerability_name", "short_description", "date_added", "due_date", "known_ransomware_use",
    "required_action", "notes", "cwes",
)


def with_content_hash(catalogue: DataFrame) -> DataFrame:
    """Catalogue with the hash of the fields it carries."""
    present = [f for f in KEV_FIELDS if f in catalogue.columns]
    return catalogue.withColumn("content_hash", stable_hash(**{f: F.col(f) for f in present}))


class EmptyFeed(ValueError):
    """An empty feed is refused: it would look like the removal of everything."""


def sync_kev(previous: DataFrame, current: DataFrame, baseline: bool | None = None) -> DataFrame:
    """(cve_id, event_type, in_catalog, content_hash): BASELINE on the very first import, else ADDED (new or returned),
    UPDATED (content hash differs), REMOVED; unchanged entries have a NULL event type.

    previous: (cve_id, content_hash, removed_at); current: from ``with_content_hash``.  ``baseline`` is found from the
    previous table when not given."""
    if current.isEmpty():
        raise EmptyFeed("the catalogue contains no entries")
    if baseline is None:
        baseline = previous.isEmpty()
    old = previous.select("cve_id", F.col("content_hash").alias("__hash"), "removed_at", F.lit(True).alias("__old"))
    both = old.join(current.select("cve_id", "content_hash", F.lit(True).alias("__new")), "cve_id", "full_outer")
    got, had = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    live = had & F.col("removed_at").isNull()
    kind = (
        F.when(got & F.lit(baseline), "KEV_BASELINE").when(got & ~live, "KEV_ADDED")
        .when(got & (F.col("content_hash") != F.col("__hash")), "KEV_UPDATED").when(~got & live, "KEV_REMOVED")
    )
    return both.select("cve_id", kind.alias("event_type"), got.alias("in_catalog"), F.coalesce("content_hash", "__hash").alias("content_hash"))
