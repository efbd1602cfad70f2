"""The certificate stream: parse, match with scope, deduplicate with a time to live, merge and report.

Two streams in a row.  The first parses messages and decides their names with the rules of the moment; what some program allows is published as a table.  The
second reads that table, accepts a certificate again only after its time to live, and commits assets, edges, links and events of a batch together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import merge
from palisade.plans import certificates as plan
from palisade.plans.base import staged, union
from palisade.schemas import ASSETS, EDGES, EVENT_COLUMNS, LINKS
from palisade.sources.certificates import parse_ct
from palisade.sources.commits import Store
from palisade.streaming.base import publish_batch, run_batches
from palisade.streaming.keyed import accepted
from palisade.streaming.route import RuleVersions

def match_stream(messages: DataFrame, read_rules: Callable[[], DataFrame], *, matched: str, checkpoint: str, outside: str | None = None, trigger=None):
    """Messages (value, observed_at, seq) to one published row per certificate with its ``matches``.

    Rules are read for every micro-batch, which fails if they are unusable.  Certificates out of scope go to ``outside``, if given, else nowhere."""

    versions = RuleVersions(read_rules)

    def process(batch: DataFrame, batch_id: int) -> None:
        rules = versions.current()
        rows = staged("ct-matched")(plan.with_matches(staged("ct-parsed")(parse_ct(batch)), rules))
        if outside is not None:
            publish_batch(rows.filter(F.size("matches") == 0).drop("matches"), outside, batch_id)
        publish_batch(rows.filter(F.size("matches") > 0), matched, batch_id)

    return run_batches(messages, process, checkpoint, trigger=trigger)


def commit_batch(rows: DataFrame, store: Store, batch_id: int) -> None:
    """Accepted certificates of one batch: all tables and events of it, visible together.  A batch without any, which only moved the watermark, changes nothing."""
    rows = staged("ct-accepted")(plan.accepted_rows(rows))
    if store.has(batch_id) or rows.isEmpty():
        return
    found, batch = plan.observed(rows), store.batch(batch_id)
    assets = batch.merge("assets", ASSETS, ["asset_type", "value"], staged("ct-assets")(found.assets), merge.upsert_assets)
    batch.merge("edges", EDGES, merge.EDGE_KEY, staged("ct-edges")(found.edges), merge.upsert_edges)
    batch.merge("links", LINKS, ["program_id", "asset_id"], staged("ct-links")(plan.link_rows(rows)), merge.link_assets)
    batch.append("events", union(plan.certificate_events(rows), plan.change_events(rows, assets)).select(*EVENT_COLUMNS))
    batch.commit()


def certificate_stream(matched: DataFrame, store: Store, *, checkpoint: str, ttl_seconds: int = 86_400, delay: str = "1 day", trigger=None):
    """The second stream, over the rows that ``match_stream`` published.

    A message that comes more than ``delay`` behind the newest one is not looked at."""
    kept = accepted(matched, F.col("fingerprint"), "observed_at", "seq", ttl_seconds, delay)
    return run_batches(kept, lambda batch, n: commit_batch(batch, store, n), checkpoint, trigger=trigger)
