"""Dashboard panels: one table of specifications over five kinds of aggregation.

Kinds: ``count``; ``unique`` (distinct values of a field); ``terms`` (most frequent values); ``table`` (nested top-n,
optionally by the maximum or average of a field); ``series`` (documents per time bucket, split by a field).  Every panel
looks at the last 30 days before ``now``.  Results share one shape: (panel, k1, k2, k3, value).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palisade.functions.common import literal_table
from palisade.plans.base import Stage, staged, union

DEFAULT_DAYS = 30


# --- predicates -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Where:
    """Conjunction of simple conditions on event fields."""

    equals: Mapping[str, tuple] = field(default_factory=dict)  # field -> accepted values
    differs: Mapping[str, tuple] = field(default_factory=dict)  # field -> refused values; a missing field passes
    exists: tuple[str, ...] = ()
    hours: int | None = None  # at most this old

    def column(self, now: Column, ts: str = "ts") -> Column:
        cond = F.lit(True)
        for f, values in self.equals.items():
            cond = cond & F.col(f).isin(*values)
        for f, values in self.differs.items():
            cond = cond & (F.col(f).isNull() | ~F.col(f).isin(*values))
        for f in self.exists:
            present = F.col(f).isNotNull()
            cond = cond & present
        if self.hours is not None:
            cond = cond & (F.col(ts) >= now - F.make_interval(hours=F.lit(self.hours)))
        return cond


def recent(now: Column, ts: str = "ts", days: int = DEFAULT_DAYS) -> Column:
    return (F.col(ts) >= now - F.make_interval(days=F.lit(days))) & (F.col(ts) <= now)


@dataclass(frozen=True)
class Panel:
    id: str
    index: str
    kind: str
    fields: tuple[str, ...] = ()
    size: int = 10
    where: Where = Where()
    metric: tuple[str, str] | None = None  # (max | avg, field)


def _p(id_: str, index: str, kind: str, *fields: str, size: int | None = None, metric=None, exists=(), hours=None, differs=None, **equals) -> Panel:
    eq = {k.replace("__", "."): v if isinstance(v, tuple) else (v,) for k, v in equals.items()}
    ne = {k.replace("__", "."): v if isinstance(v, tuple) else (v,) for k, v in (differs or {}).items()}
    n = size if size is not None else (20 if kind == "table" else 8 if kind == "series" else 10)
    return Panel(id_, index, kind, fields, n, Where(eq, ne, tuple(exists), hours), metric)


# --- specifications (fixed values) --------------------------------------------------------------------------
NEW_ASSETS = ("NEW_DOMAIN", "NEW_SUBDOMAIN", "NEW_IP", "NEW_URL")
CERTIFICATE_CHANGES = (
    "NEW_CERTIFICATE", "CERT_CHANGED", "FINGERPRINT_CHANGED", "SAN_CHANGED", "ISSUER_CHANGED", "TLS_VERSION_CHANGED",
    "CERT_EXPIRING", "CERTIFICATE_EXPIRED", "TLS_CHANGED",
)
KEV_EVENTS = ("KEV_ADDED", "KEV_UPDATED", "KEV_REMOVED")
_NOT_BLOCKED = {"event__type": "SCOPE_BLOCKED"}

OVERVIEW = (
    _p("ov-assets", "bb-assets", "unique", "asset.id"),
    _p("ov-subdomains", "bb-assets", "unique", "asset.id", asset__type=("domain", "subdomain")),
    _p("ov-urls", "bb-http", "unique", "url.full"),
    _p("ov-new24", "bb-changes", "count", event__type=NEW_ASSETS, hours=24),
    _p("ov-changed24", "bb-changes", "unique", "asset.id", hours=24),
    _p("ov-types", "bb-assets", "terms", "asset.type"),
    _p("ov-tech", "bb-http", "terms", "technology.name", size=15),
    _p("ov-status", "bb-http", "terms", "http.response.status_code"),
    _p("ov-cdn", "bb-http", "terms", "http.cdn.name"),
    _p("ov-asn", "bb-all", "terms", "asn.number"),
    _p("ov-cloud", "bb-all", "terms", "cloud.provider"),
    _p("ov-programs", "bb-all", "table", "program.name", "bb.index"),
    _p("ov-ts-new", "bb-changes", "series", "event.type", event__type=(*NEW_ASSETS, "NEW_CERTIFICATE")),
)
CERTIFICATES = (
    _p("ct-certs", "bb-tls", "unique", "tls.fingerprint"),
    _p("ct-new", "bb-changes", "count", event__type="NEW_CERTIFICATE"),
    _p("ct-expiring", "bb-tls", "unique", "tls.fingerprint", tls__expiry_status="expiring"),
    _p("ct-expired", "bb-tls", "unique", "tls.fingerprint", tls__expiry_status="expired"),
    _p("ct-issuer", "bb-tls", "terms", "tls.issuer_cn"),
    _p("ct-version", "bb-tls", "terms", "tls.version"),
    _p("ct-cipher", "bb-tls", "terms", "tls.cipher"),
    _p("ct-changes", "bb-changes", "table", "asset.value", "event.type", event__type=CERTIFICATE_CHANGES),
    _p("ct-exp-table", "bb-tls", "table", "asset.value", "tls.not_after", "tls.expiry_status", tls__expiry_status=("expiring", "expired")),
    _p("ct-interesting", "bb-certstream", "unique", "asset.value", certstream__interesting=True),
    _p("ct-flags", "bb-certstream", "terms", "certstream.flags", certstream__interesting=True),
    _p("ct-interesting-table", "bb-certstream", "table", "asset.value", "certstream.flags", size=50, certstream__interesting=True),
)
WEB = (
    _p("wt-tech", "bb-http", "terms", "technology.name", size=20),
    _p("wt-server", "bb-http", "terms", "http.webserver"),
    _p("wt-status", "bb-http", "terms", "http.response.status_code"),
    _p("wt-versions", "bb-http", "table", "technology.name", "technology.version", exists=("technology.version",)),
    _p("wt-titles", "bb-http", "table", "http.title", "url.domain"),
    _p("wt-favicon", "bb-http", "table", "http.favicon.mmh3", "url.domain", exists=("http.favicon.mmh3",)),
    _p("wt-cdn", "bb-http", "table", "http.cdn.name", "http.cdn.type", "url.domain", http__cdn__detected=True),
)
VULNERABILITIES = (
    _p("vu-corr", "bb-cve", "count"),
    _p("vu-assets", "bb-cve", "unique", "asset.id"),
    _p("vu-kev-hits", "bb-cve", "unique", "cve.id", kev__in_catalog=True),
    _p("vu-kev-total", "bb-kev", "unique", "cve.id", kev__in_catalog=True),
    _p("vu-status", "bb-cve", "terms", "vulnerability.status"),
    _p("vu-sev", "bb-cve", "terms", "cvss.severity"),
    _p("vu-cpe-conf", "bb-cve", "terms", "cve.cpe_confidence_level"),
    _p("vu-assets-table", "bb-cve", "table", "asset.value", "cve.id", "technology.version", size=50),
    _p("vu-epss", "bb-cve", "table", "cve.id", metric=("max", "epss.score")),
    _p("vu-kev-vendors", "bb-kev", "table", "kev.vendor", kev__in_catalog=True),
    _p("vu-kev-changes", "bb-kev", "table", "event.type", "cve.id", event__type=KEV_EVENTS),
    _p("vu-nuclei-sev", "bb-nuclei", "terms", "nuclei.severity"),
)
CHANGES = (
    _p("ch-total", "bb-changes", "count", differs=_NOT_BLOCKED),
    _p("ch-blocked", "bb-changes", "count", event__type="SCOPE_BLOCKED"),
    _p("ch-ts", "bb-changes", "series", "event.type", differs=_NOT_BLOCKED),
    _p("ch-types", "bb-changes", "terms", "event.type", size=25),
    _p("ch-programs", "bb-changes", "terms", "program.name"),
    _p("ch-recent", "bb-changes", "table", "asset.value", "event.type", "change.current", size=50, differs=_NOT_BLOCKED),
    _p("ch-scope", "bb-changes", "table", "asset.value", "scope_check.layer", "scope_check.reason", event__type="SCOPE_BLOCKED"),
)
RECON = (
    _p("rc-urls", "bb-urls", "unique", "url.hash"),
    _p("rc-endpoints", "bb-urls", "unique", "url.endpoint_hash"),
    _p("rc-js", "bb-urls", "unique", "url.hash", url__js_discovered=True),
    _p("rc-ips", "bb-ips", "unique", "host.ip"),
    _p("rc-bbot-types", "bb-bbot", "terms", "bbot.type", size=15, differs={"bbot__type": "SCAN"}),
    _p("rc-bbot-modules", "bb-bbot", "terms", "bbot.module", size=15),
    _p("rc-cloud", "bb-ips", "terms", "cloud.provider"),
    _p("rc-endpoints-host", "bb-urls", "table", "url.domain", "url.path", size=50),
    _p("rc-uncover", "bb-uncover", "table", "uncover.engine", "scope_check.allowed", "asset.value"),
    _p("rc-new", "bb-changes", "table", "asset.value", "event.type", "change.current", event__type=("NEW_ENDPOINT", "NEW_PORT", "PORT_REMOVED")),
)
OPERATIONS = (
    _p("op-jobs", "bb-jobs", "count", event__category="job"),
    _p("op-running", "bb-jobs", "count", job__status="RUNNING"),
    _p("op-failed", "bb-jobs", "count", job__status="FAILED"),
    _p("op-blocked", "bb-jobs", "count", job__status=("BLOCKED", "OUT_OF_SCOPE")),
    _p("op-dlq", "bb-errors", "count", event__type="DLQ_EVENT"),
    _p("op-ts-jobs", "bb-jobs", "series", "job.status", event__category="job"),
    _p("op-status", "bb-jobs", "terms", "job.status", event__category="job"),
    _p("op-scanner", "bb-jobs", "terms", "job.scanner", event__category="job"),
    _p("op-block", "bb-jobs", "terms", "job.block_reason", exists=("job.block_reason",)),
    _p("op-duration", "bb-jobs", "table", "job.scanner", metric=("avg", "job.duration_seconds"), job__status="SUCCESS"),
    _p("op-queue", "bb-jobs", "table", "queue.name", metric=("max", "queue.pending"), event__type="QUEUE_DEPTH"),
    _p("op-errors", "bb-errors", "table", "error.type", "scan.tool"),
    _p("op-notify-status", "bb-notifications", "terms", "notification.status"),
    _p("op-ts-notify", "bb-notifications", "series", "notification.type"),
    _p("op-notify-types", "bb-notifications", "table", "notification.type", "notification.channel", "notification.status"),
)
DASHBOARDS = {
    "overview": OVERVIEW, "certificates": CERTIFICATES, "web": WEB, "vulnerabilities": VULNERABILITIES, "changes": CHANGES,
    "recon": RECON, "operations": OPERATIONS,
}


# --- evaluation ---------------------------------------------------------------------------------------------
#
# Every document gives one entry per panel that it matches, level of the panel's keys, and combination of its values; one aggregation of the entries by
# (panel, level, keys) serves all panels of an index, and what is left to do is on its result.

KEYS = ("k1", "k2", "k3")
ENTRY = "array<struct<panel:string,level:int,k1:string,k2:string,k3:string,m:double>>"


def values(df: DataFrame, path: str) -> Column:
    """A field as an array of its different values as text, nulls left out."""
    c = F.col(path)
    many = F.array_distinct(c) if isinstance(df.select(path).schema[0].dataType, T.ArrayType) else F.array(c)
    return F.array_compact(many.cast("array<string>"))


def entries(df: DataFrame, panel: Panel, now: Column, interval: str) -> Column:
    """The entries of a document for one panel, as an array (empty where the panel does not look at the document)."""
    metric = F.col(panel.metric[1]).cast("double") if panel.metric else F.lit(None).cast("double")

    def level_rows(level: int, fields: Sequence[Column]) -> Column:
        """One struct for each combination of the values of the fields."""
        def combine(i: int, found: list[Column]) -> Column:
            if i == len(fields):
                ks = [*found, *[F.lit(None).cast("string")] * (3 - len(found))]
                return F.array(F.struct(F.lit(panel.id).alias("panel"), F.lit(level).alias("level"), *(k.alias(n) for k, n in zip(ks, KEYS)), metric.alias("m")))
            return F.flatten(F.transform(fields[i], lambda v: combine(i + 1, [*found, v])))

        return combine(0, [])

    fields = [values(df, f) for f in panel.fields]
    if panel.kind == "count":
        rows = level_rows(1, [])
    elif panel.kind in ("unique", "terms"):
        rows = level_rows(1, fields)
    elif panel.kind == "table":
        rows = F.concat(*(level_rows(i, fields[:i]) for i in range(1, len(fields) + 1)))
    elif panel.kind == "series":
        rows = level_rows(1, [F.array_compact(F.array(F.date_format(F.date_trunc(interval, F.col("ts")), "yyyy-MM-dd HH:mm:ss"))), *fields])
    else:
        raise ValueError(panel.kind)
    return F.when(recent(now) & panel.where.column(now), rows.cast(ENTRY)).otherwise(F.array().cast(ENTRY))


def index_buckets(events: DataFrame, panels: Sequence[Panel], now: Column, interval: str = "day", exact: bool = True) -> DataFrame:
    """(panel, level, k1, k2, k3, n, most, mean, sketch) of all panels of one index in one pass over its recent documents.

    ``sketch`` has the values of a ``unique`` panel unless ``exact``; then every value is a bucket."""
    rows = window_of(events, panels, now)
    rows = rows.select(F.explode(F.concat(*(entries(rows, p, now, interval) for p in panels))).alias("e")).select("e.*")
    sketched = F.lit(None).cast("string")
    if not exact:
        unique = F.col("panel").isin([p.id for p in panels if p.kind == "unique"] or [""])
        rows = rows.withColumns({"v": F.when(unique, F.col("k1")), "k1": F.when(~unique, F.col("k1"))})
        sketched = F.col("v")
    return rows.groupBy("panel", "level", *KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.max("m").alias("most"), F.avg("m").alias("mean"), *([] if exact else [F.hll_sketch_agg(sketched).alias("sketch")]))


def panel_results(buckets: DataFrame, panels: Sequence[Panel]) -> DataFrame:
    """(panel, k1, k2, k3, value) from the buckets of all indices: totals, distinct values, nested best n, the most frequent series."""
    spec = [(p.id, p.kind, p.size, len(p.fields) if p.kind == "table" else 1, p.metric[0] if p.metric else "count") for p in panels]
    known = literal_table(buckets.sparkSession, spec, "panel string, kind string, size int, levels int, metric string")
    value = F.when(F.col("metric") == "max", F.col("most")).when(F.col("metric") == "avg", F.col("mean")).otherwise(F.col("n").cast("double"))
    rows = buckets.join(F.broadcast(known), "panel").withColumn("value", value)
    shape = ["panel", *KEYS, "value"]
    blank = [F.lit(None).cast("string").alias(k) for k in KEYS]
    distinct = F.hll_sketch_estimate(F.hll_union_agg("sketch")) if "sketch" in buckets.columns else F.count(F.lit(1))
    totals = rows.filter("kind = 'count'").groupBy("panel").agg(F.sum("value").alias("v")).unionByName(rows.filter("kind = 'unique'").groupBy("panel").agg(distinct.cast("double").alias("v")))
    single = known.filter("kind IN ('count', 'unique')").join(totals, "panel", "left")
    out = [single.select("panel", *blank, F.coalesce("v", F.lit(0.0)).alias("value"))]
    most = max(p.size for p in panels)
    ranked, keep = rows.filter("kind IN ('terms', 'table')"), None
    for level in (1, 2, 3):
        parent, here = ["panel", *KEYS[: level - 1]], ranked.filter(F.col("level") == level)
        if keep is not None:
            here = here.join(keep.select(*parent), parent, "left_semi")
        order = Window.partitionBy(*parent).orderBy(F.desc("value"), KEYS[level - 1])
        keep = here.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).filter(F.col("__r") <= F.col("size"))
        out.append(keep.filter(F.col("levels") == level).select(*shape))
    series = rows.filter("kind = 'series'")
    order = Window.partitionBy("panel").orderBy(F.desc("all"), "k2")
    top = series.groupBy("panel", "size", "k2").agg(F.sum("value").alias("all")).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).filter(F.col("__r") <= F.col("size"))
    out.append(series.join(top.select("panel", "k2"), ["panel", "k2"], "left_semi").select(*shape))
    return union(*out)


def used_columns(panels: Sequence[Panel]) -> set[str]:
    """Top-level columns that the panels read."""
    paths = {"ts"}
    for p in panels:
        paths |= {*p.fields, *p.where.equals, *p.where.differs, *p.where.exists, *([p.metric[1]] if p.metric else [])}
    return {path.split(".")[0] for path in paths}


def window_of(events: DataFrame, panels: Sequence[Panel], now: Column) -> DataFrame:
    """What the panels of one index look at: its recent documents with the columns they read; months outside the window are pruned
    where the table has them as a partition column."""
    rows = events.filter(recent(now))
    if "ym" in events.columns:
        first = F.date_format(now - F.make_interval(days=F.lit(DEFAULT_DAYS)), "yyyy.MM")
        rows = rows.filter(F.col("ym").between(first, F.date_format(now, "yyyy.MM")))
    used = used_columns(panels)
    return rows.select(*[c for c in events.columns if c in used])


def run_dashboard(
    indices: Mapping[str, DataFrame], name: str, now: Column, interval: str = "day", exact: bool = True, stage: Stage = staged("panel-buckets"),
) -> DataFrame:
    """All panels of a dashboard; ``indices`` maps index names (``bb-all`` included where used) to event tables.

    Every index is scanned once and aggregated once; the buckets are written (``stage``), and the panels read those.  ``exact``: distinct values are counted,
    else estimated by sketches."""
    panels = DASHBOARDS[name]
    parts = [index_buckets(indices[i], [p for p in panels if p.index == i], now, interval, exact) for i in dict.fromkeys(p.index for p in panels)]
    return panel_results(stage(union(*parts)), panels)


def daily_sketches(events: DataFrame, panels: Sequence[Panel], now: Column) -> DataFrame:
    """(panel, day, sketch) of the ``unique`` panels of one index without a limit in hours: what to append to a stored table once a day is over."""
    kept = [p for p in panels if p.kind == "unique" and p.where.hours is None]

    def found_in(p: Panel) -> Column:
        return F.when(p.where.column(now), F.transform(values(events, p.fields[0]), lambda v: F.struct(F.lit(p.id).alias("panel"), v.alias("v"))))

    found = [found_in(p) for p in kept]
    empty = F.array().cast("array<struct<panel:string,v:string>>")
    rows = events.select(F.to_date("ts").alias("day"), F.explode(F.concat(empty, *(F.coalesce(f, empty) for f in found))).alias("e"))
    return rows.groupBy("e.panel", "day").agg(F.hll_sketch_agg("e.v").alias("sketch"))


def distinct_over_days(sketches: DataFrame, first: Column, last: Column) -> DataFrame:
    """(panel, value): estimated distinct values over whole days, by merging one sketch per panel and day."""
    days = sketches.filter(F.col("day").between(first, last))
    return days.groupBy("panel").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("value"))
