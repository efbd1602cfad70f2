"""From the results of an observation plan to tables and events, committed together.

Per batch: validated rows, assets and edges are merged, program membership is linked, states are paired with the stored ones and compared, scanned
assets move on in their life cycle, and every kind of event of the batch is written; all of it becomes visible by one manifest (``sources.commits``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.targets import asset_type
from palisade.operators import changes as diffs
from palisade.operators import merge
from palisade.operators.skew import last_per_key
from palisade.plans.base import Observed, asset_rows, pair_states, staged, union
from palisade.plans.http import http_events
from palisade.schemas import ASSETS, EDGES, EVENT_COLUMNS, LINKS
from palisade.sources.commits import Batch, Store
from palisade.sources.events import build_event

#: Of a reported row: its program and job, and the asset that its events are about.
SUBJECT = ["seq", "observed_at", "program_id", "job_id", "about_type", "about"]


@dataclass(frozen=True)
class Flow:
    """What is particular to a plan.

    subject: (type, value) of the asset a row is about; observations: the events of the rows; found: assets that are reported when they are new, as
    (asset_type, value, seq, observed_at, change_type, field); diff: comparison of paired states; scanned: (asset_type, value, stage, active) columns of each asset
    that an accepted row moves on; alerts: whether refused rows are reported as blocked; runs: what is compared run by run (see ``Runs``)."""

    tool: str
    index: str
    subject: tuple[Column, Column]
    observations: Callable[[DataFrame], DataFrame]
    found: Callable[[Observed, DataFrame], DataFrame] | None = None
    diff: Callable[[DataFrame, list[str]], DataFrame] | None = None
    scanned: tuple[tuple[Column, Column, Column, Column], ...] = ()
    confidence: float = 0.95
    alerts: bool = True
    runs: Runs | None = None


@dataclass(frozen=True)
class Runs:
    """Comparison of a run with the run of the same owner before it, which the store keeps.

    owner: the asset that lines are about, as (type, value); key: the columns that owners and runs are compared by; members: what an owner's run found, as
    (owner, job_id, member, detail columns); diff: change rows of members (owner, run, ...) and all runs; shown: the snapshot of a run from its members."""

    owner: tuple[Column, Column]
    key: Column
    member: str
    members: Callable[[Observed], DataFrame]
    diff: Callable[[DataFrame, str, str, DataFrame], DataFrame]
    facet: str
    stage: str
    reason: str


def _context(tool: str) -> dict:
    return {
        "program": {"id": F.col("program_id").cast("string")}, "asset": {"type": F.col("about_type"), "value": F.col("about")},
        "scan": {"job_id": F.col("job_id").cast("string"), "tool": F.lit(tool)}, "source": {"name": F.lit(tool), "type": F.lit("active")},
    }


def _at() -> Column:
    return F.col("observed_at").cast("timestamp")


def raw_events(lines: DataFrame, flow: Flow) -> DataFrame:
    """Every line as it came; malformed ones as text, and one error event per job that counts them."""
    text = F.col("value")
    df = lines.withColumn("__raw", F.try_parse_json(text)).withColumns({"about_type": F.lit(None).cast("string"), "about": F.lit(None).cast("string")})
    ok = F.coalesce(F.startswith(F.ltrim(text), F.lit("{")) & F.col("__raw").isNotNull(), F.lit(False))
    ctx = dict(index=f"bb-{flow.tool}-raw", kind="event", category="raw", type_="RAW_OUTPUT", ts=_at(), context=_context(flow.tool), keep=["seq"])
    good = build_event(df.filter(ok), body={"raw": F.col("__raw")}, **ctx)
    bad = build_event(df.filter(~ok), body={"raw": {"line": text}, "error": {"type": F.lit("MALFORMED_SCANNER_OUTPUT")}}, **ctx)
    per_job = df.filter(~ok).groupBy("program_id", "job_id").agg(F.count(F.lit(1)).alias("n"), F.max("observed_at").alias("observed_at"), F.max("seq").alias("seq"))
    per_job = per_job.withColumns({"about_type": F.lit(None).cast("string"), "about": F.lit(None).cast("string")})
    message = F.concat(F.col("n").cast("string"), F.lit(f" malformed {flow.tool} lines"))
    errors = build_event(
        per_job, index="bb-errors", kind="event", category="error", type_="MALFORMED_SCANNER_OUTPUT", ts=_at(), context=_context(flow.tool), keep=["seq"],
        body={"error": {"type": F.lit("MALFORMED_SCANNER_OUTPUT"), "message": message}})
    return union(good, bad, errors)


def blocked_events(rows: DataFrame, flow: Flow, layer: str = "scanner_output") -> DataFrame:
    """A SCOPE_BLOCKED alert for every refused row."""
    d = F.col("decision")
    return build_event(
        rows.filter(~d["allowed"]), index="bb-changes", kind="alert", category="scope", type_="SCOPE_BLOCKED", ts=_at(), keep=["seq"],
        context={
            "program": {"id": F.col("program_id").cast("string")}, "scope": {"id": d["scope_id"], "status": F.when(d["match_kind"] == "explicit_exclusion", "excluded").otherwise("out")},
            "asset": {"type": d["kind"], "value": d["value"]}, "scan": {"job_id": F.col("job_id").cast("string"), "tool": F.lit(flow.tool)},
            "source": {"name": F.lit(layer), "type": F.lit("system")},
        },
        body={"scope_check": {"allowed": F.lit(False), "reason": d["reason"], "layer": F.lit(layer)}})


def new_asset_rows(found: DataFrame, new_keys: DataFrame) -> DataFrame:
    """(seq, change_type, field, previous, current) of found assets that the store did not have, for the first row that shows them."""
    first = found.join(new_keys, ["asset_type", "value"]).groupBy("asset_type", "value").agg(F.min_by(F.struct("seq", "change_type", "field"), F.struct("observed_at", "seq")).alias("m"))
    return first.select("m.*", F.lit(None).cast("string").alias("previous"), F.col("value").alias("current"))


def commit(found: Observed, lines: DataFrame, flow: Flow, store: Store, number: int) -> bool:
    """Write one batch of a plan; false if it was written before.  ``found.rows`` should be staged, as it is read several times."""
    if store.has(number):
        return False
    batch = store.batch(number)
    rows = found.rows.withColumns({"about_type": flow.subject[0], "about": flow.subject[1]})
    ok = rows.filter(F.col("decision.allowed"))
    events = [flow.observations(rows), raw_events(lines, flow)]
    if flow.alerts:
        events.append(blocked_events(found.rows, flow))
    changed, scanned, assets = [], [], [found.assets] if found.assets is not None else []
    subjects = staged("flow-subjects")(ok.select(*SUBJECT))
    if flow.diff is not None:
        compared, shown = compared_states(found, flow, batch)
        changed.append(compared.join(subjects, "seq"))
        events.append(snapshot_events(shown.join(subjects, "seq"), flow))
    if flow.runs is not None:
        runs, compared, shown = compared_runs(found, lines, flow, batch, number)
        changed.append(compared)
        events.append(snapshot_events(shown, flow))
        assets.append(asset_rows(runs, F.col("about_type"), F.col("about"), flow.tool, flow.runs.reason))
        scanned.append(runs.withColumns({"stage": F.lit(flow.runs.stage), "active": F.lit(None).cast("boolean")}))
    assets, key = staged("flow-assets")(union(*assets)), ["asset_type", "value"]
    if flow.found is not None:
        new_keys = assets.select(*key).distinct().join(batch.current("assets", ASSETS, key, assets).select(*key), key, "left_anti")
        changed.append(new_asset_rows(flow.found(found, ok), new_keys).join(subjects, "seq"))
    columns = [*SUBJECT, "change_type", "field", "previous", "current"]
    changed = staged("flow-changes")(union(*(c.select(*columns) for c in changed)))
    events.append(build_event(
        changed, index="bb-changes", kind="event", category="change", type_=F.col("change_type"), ts=_at(), context=_context(flow.tool), keep=["seq"],
        body={
            "change": {"type": F.col("change_type"), "field": F.col("field"), "previous": F.col("previous"), "current": F.col("current")},
            "confidence": {"score": F.lit(flow.confidence), "source": F.lit(flow.tool)},
        }))
    scanned += [ok.select("seq", "observed_at", kind.alias("about_type"), value.alias("about"), stage.alias("stage"), active.alias("active")) for kind, value, stage, active in flow.scanned]
    batch.merge("assets", ASSETS, key, assets, lambda cur, new: scanned_assets(merge.upsert_assets(cur, new), scanned, changed))
    if found.edges is not None:
        batch.merge("edges", EDGES, merge.EDGE_KEY, staged("flow-edges")(found.edges), merge.upsert_edges)
    d = F.col("decision")
    links = ok.select("program_id", F.col("about").alias("asset_id"), d["allowed"].alias("allowed"), d["match_kind"].alias("match_kind"), d["scope_id"].alias("scope_id"), d["reason"].alias("reason"),
                      _at().alias("seen_at"), "seq")
    batch.merge("links", LINKS, ["program_id", "asset_id"], staged("flow-links")(links), merge.link_assets)
    batch.append("events", union(*(e.select(*EVENT_COLUMNS) for e in events)))
    return batch.commit()


def compared_states(found: Observed, flow: Flow, batch: Batch) -> tuple[DataFrame, DataFrame]:
    """Change rows by seq against the stored states, and what snapshots show; the newest states are stored."""
    columns, owner = ["asset_id", "facet", "observed_at", "current"], ["asset_id", "facet"]
    states = staged("flow-states")(found.states.select(*columns, F.col("seq").cast("long").alias("seq")))
    name, schema = f"states_{flow.tool}", states.select(*columns).schema
    before = batch.current(name, schema, owner, states).join(states.select(*owner).distinct(), owner, "left_semi")
    compared = flow.diff(pair_states(states, before), ["seq"])

    def newest(cur: DataFrame, new: DataFrame) -> DataFrame:
        return last_per_key(cur.withColumn("seq", F.lit(-1).cast("long")).unionByName(new), owner, [F.col("observed_at"), F.col("seq")]).drop("seq")

    batch.merge(name, schema, owner, states, newest)
    return compared, states.select("seq", F.to_json(F.struct("facet", F.col("current").alias("state"))).alias("snapshot"))


def compared_runs(found: Observed, lines: DataFrame, flow: Flow, batch: Batch, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The runs of the batch, change rows of each against the owner's run before it, and what snapshots show.

    A run is (owner, job); runs go by batch, then job.  The store keeps the members of an owner's last run, and one row without member for the run itself."""
    r = flow.runs
    run = F.concat(F.lit(f"{number:012d}|"), F.col("job_id"))
    runs = lines.withColumns({"owner": r.key, "about_type": r.owner[0], "about": r.owner[1]}).filter(F.col("owner").isNotNull() & F.col("about").isNotNull())
    runs = runs.groupBy("owner", "job_id").agg(*(F.max_by(c, F.struct("observed_at", "seq")).alias(c) for c in ("program_id", "about_type", "about")), F.max("observed_at").alias("observed_at"), F.max("seq").alias("seq"))
    runs = staged("flow-runs")(runs.withColumn("run", run))
    members = r.members(found).withColumn("run", run).drop("job_id")
    marks = runs.select("owner", "run", *(F.lit(None).cast(t).alias(c) for c, t in members.dtypes if c not in ("owner", "run")))
    new = staged("flow-members")(members.unionByName(marks))
    name = f"runs_{flow.tool}"
    both = batch.current(name, new.schema, ["owner"], runs).join(runs.select("owner").distinct(), "owner", "left_semi").unionByName(new)
    both = staged("flow-both")(both)
    compared = r.diff(both.filter(F.col(r.member).isNotNull()), "owner", "run", both.select("owner", "run").distinct()).join(runs, ["owner", "run"])

    def last_run(cur: DataFrame, fresh: DataFrame) -> DataFrame:
        rows = cur.unionByName(fresh)
        return rows.join(rows.groupBy("owner").agg(F.max("run").alias("run")), ["owner", "run"]).select(*fresh.columns)

    batch.merge(name, new.schema, ["owner"], new, last_run)
    counts = members.groupBy("owner", "run").agg(F.count(F.lit(1)).alias("n"))
    shown = runs.join(counts, ["owner", "run"], "left").withColumn("snapshot", F.to_json(F.struct(F.concat(F.lit(r.facet), "owner").alias("facet"), F.struct(F.coalesce("n", F.lit(0)).alias("members")).alias("state"))))
    return runs, compared, shown


def snapshot_events(shown: DataFrame, flow: Flow) -> DataFrame:
    """ASSET_SNAPSHOT events of rows with SUBJECT and ``snapshot``, a JSON text."""
    return build_event(
        shown.withColumn("snapshot", F.parse_json("snapshot")), index="bb-assets", kind="state", category="asset", type_="ASSET_SNAPSHOT", ts=_at(), context=_context(flow.tool),
        body={"snapshot": F.col("snapshot")}, keep=["seq"])


def scanned_assets(assets: DataFrame, scanned: list[DataFrame], changed: DataFrame) -> DataFrame:
    """The assets with the life cycle of those that rows (seq, observed_at, about_type, about, stage, active) were about."""
    if not scanned:
        return assets
    name = lambda t, v: F.concat_ws("|", t, v)
    outcomes = union(*(x.filter(F.col("about").isNotNull()).select(name("about_type", "about").alias("asset_id"), _at().alias("scanned_at"), "stage", "active", "seq") for x in scanned))
    outcomes = outcomes.join(changed.select("seq").distinct().withColumn("__moved", F.lit(True)), "seq", "left").withColumn("changed", F.coalesce("__moved", F.lit(False)))
    return merge.mark_scanned(assets.withColumn("asset_id", name("asset_type", "value")), outcomes).drop("asset_id")


# --- HTTP ----------------------------------------------------------------------------------------------------


def _http_found(found: Observed, ok: DataFrame) -> DataFrame:
    url = ok.select(F.lit("url").alias("asset_type"), F.col("url").alias("value"), "seq", "observed_at", F.lit("NEW_URL").alias("change_type"), F.lit("url.full").alias("field"))
    ip = ok.filter((F.col("u.host_type") == "domain") & F.col("ip").isNotNull()).select(
        F.when(F.length("ip_bits") == 32, "ipv4").otherwise("ipv6").alias("asset_type"), F.col("ip").alias("value"), "seq", "observed_at", F.lit("NEW_IP").alias("change_type"), F.lit("host.ip").alias("field"))
    return url.unionByName(ip)


def http_flow() -> Flow:
    stage = F.when(F.size("technologies") > 0, "TECH_IDENTIFIED").otherwise("HTTP_PROBED")
    host = F.when(F.col("u.host_type") == "domain", F.col("u.host"))
    return Flow(
        "httpx", "bb-http", (F.lit("url"), F.col("url")), http_events, _http_found, diffs.diff_http,
        ((F.lit("url"), F.col("url"), stage, F.lit(True)), (asset_type(F.lit("domain"), F.col("u.host")), host, stage, F.lit(True))))


# --- TLS -----------------------------------------------------------------------------------------------------


def tls_events(rows: DataFrame) -> DataFrame:
    """TLS_OBSERVATION events of accepted handshakes."""
    fields = ("cipher", "sni", "fingerprint", "cn", "san", "serial", "subject", "issuer", "issuer_cn", "issuer_org", "not_before", "not_after", "self_signed", "mismatched", "expired", "expiry_status", "days_until_expiry")
    return build_event(
        rows.filter(F.col("decision.allowed")), index="bb-tls", kind="event", category="network", type_="TLS_OBSERVATION", ts=_at(), context=_context("tlsx"), keep=["seq"],
        body={"tls": {"version": F.col("tls_version"), **{f: F.col(f) for f in fields}}, "host": {"ip": F.col("ip")}, "network": {"port": F.col("port")}, "certificate": {"asset_value": F.col("fingerprint")}})


def _tls_found(found: Observed, ok: DataFrame) -> DataFrame:
    """Presented certificates, and approved alternative names other than the hosts of the batch, which are stored before them."""
    cert = ok.select(F.lit("certificate").alias("asset_type"), F.col("fingerprint").alias("value"), "seq", "observed_at", F.lit("NEW_CERTIFICATE").alias("change_type"), F.lit("tls.fingerprint").alias("field"))
    hosts = ok.select(F.col("about").alias("value")).distinct()
    sans = found.extra["sans"].select(
        asset_type(F.lit("domain"), F.col("san_name")).alias("asset_type"), F.col("san_name").alias("value"), "seq", "observed_at", F.lit("NEW_SUBDOMAIN").alias("change_type"), F.lit("tls.san").alias("field"))
    return cert.unionByName(sans.join(hosts, "value", "left_anti").select(*cert.columns))


def tls_flow() -> Flow:
    d = F.col("decision")
    kind = asset_type(d["kind"], d["value"])
    return Flow("tlsx", "bb-tls", (kind, d["value"]), tls_events, _tls_found, diffs.diff_tls, ((kind, d["value"], F.lit("TLS_IDENTIFIED"), F.lit(True)),))


# --- search engines ------------------------------------------------------------------------------------------


def search_events(rows: DataFrame) -> DataFrame:
    """UNCOVER_RESULT events of all distinct targets, refused ones included."""
    d = F.col("decision")
    return build_event(
        rows, index="bb-uncover", kind="event", category="discovery", type_="UNCOVER_RESULT", ts=_at(), context=_context("uncover"), keep=["seq"],
        body={"uncover": {"engine": F.col("engine"), "port": F.col("port")}, "scope_check": {"allowed": d["allowed"], "reason": d["reason"], "layer": F.lit("discovery")}})


def search_flow() -> Flow:
    d = F.col("decision")
    kind = asset_type(d["kind"], d["value"])
    new = F.when(d["kind"].isin("ipv4", "ipv6"), "NEW_IP").when(d["kind"] == "domain", "NEW_SUBDOMAIN").otherwise("NEW_ASSET")
    return Flow(
        "uncover", "bb-uncover", (kind, d["value"]), search_events,
        lambda found, ok: ok.select(F.col("about_type").alias("asset_type"), F.col("about").alias("value"), "seq", "observed_at", new.alias("change_type"), F.lit("uncover").alias("field")),
        confidence=0.5, alerts=False)


# --- crawl, findings: compared run by run --------------------------------------------------------------------


def crawl_events(found: Observed) -> Callable[[DataFrame], DataFrame]:
    def events(rows: DataFrame) -> DataFrame:
        """CRAWLED_URL and the inventory document of each URL, once per crawl."""
        first = found.extra["urls"].select("job_id", "seq")
        once = rows.filter(F.col("decision.allowed")).join(first, ["job_id", "seq"])
        u = F.col("u")
        body = {
            "url": {
                "full": F.col("url"), "domain": u["host"], "scheme": u["scheme"], "port": u["port"], "path": u["path"], "query": u["query"], "hash": F.col("url_hash"), "endpoint_hash": F.col("endpoint_hash"),
                "parameters": u["parameters"], "method": F.col("method"), "parent": F.col("parent"), "js_discovered": F.col("js_discovered"),
            },
            "katana": {"tag": F.col("tag"), "attribute": F.col("attribute")}, "http": {"response": F.when(F.col("status_code").isNotNull(), F.struct("status_code"))},
        }
        common = dict(category="web", ts=_at(), context=_context("katana"), body=body, keep=["seq"])
        seen = build_event(once, index="bb-katana", kind="event", type_="CRAWLED_URL", **common)
        return seen.unionByName(build_event(once, index="bb-urls", kind="state", type_="URL_INVENTORY", doc_id=F.col("url_hash"), **common))

    return events


def crawl_flow(found: Observed) -> Flow:
    """Lines carry ``origin``, the start of the crawl."""
    host = F.regexp_extract("origin", "^https?://([^/:]+)", 1)
    members = found.extra["endpoints"].select(F.col("origin").alias("owner"), "job_id", "endpoint_hash", "endpoint")
    return Flow(
        "katana", "bb-katana", (F.lit("url"), F.col("url")), crawl_events(found), confidence=0.9,
        runs=Runs((asset_type(F.lit("domain"), host), host), F.col("origin"), "endpoint_hash", lambda _: members, changes_of(diffs.diff_endpoints), "crawl:", "CRAWLED", "crawled host responded"))


def finding_events(rows: DataFrame) -> DataFrame:
    """VULNERABILITY_DETECTED events of accepted records."""
    plain = ("template_id", "template_path", "name", "severity", "ip", "tags", "description", "reference", "matcher_status", "extracted_results", "curl_command")
    known = (F.size("cves") > 0) | (F.size("cwes") > 0) | F.col("cvss_score").isNotNull()
    classes = F.when(known, F.struct(F.col("cves").alias("cve"), F.col("cwes").alias("cwe"), "cvss_metrics", "cvss_score"))
    u = F.col("u")
    return build_event(
        rows.filter(F.col("decision.allowed")), index="bb-nuclei", kind="event", category="vulnerability", type_="VULNERABILITY_DETECTED", ts=_at(), context=_context("nuclei"), keep=["seq"],
        body={
            "nuclei": {**{c: F.col(c) for c in plain}, "matched_at": F.col("url"), "host": F.col("target_host"), "classification": classes},
            "url": {"full": F.col("url"), "domain": u["host"], "scheme": u["scheme"], "port": u["port"], "path": u["path"], "hash": u["url_hash"]},
        })


def findings_flow(found: Observed) -> Flow:
    """Lines carry ``host``, the scanned one."""
    members = found.extra["members"].select(F.col("host").alias("owner"), "job_id", "finding_hash", "severity", "template_id", "url")
    return Flow(
        "nuclei", "bb-nuclei", (F.lit("url"), F.col("url")), finding_events, confidence=0.9,
        runs=Runs((asset_type(F.lit("domain"), F.col("host")), F.col("host")), F.col("host"), "finding_hash", lambda _: members, changes_of(diffs.diff_findings), "vulnscan:", "VULN_SCANNED", "vulnerability scan target"))


def changes_of(diff: Callable) -> Callable[[DataFrame, str, str, DataFrame], DataFrame]:
    return lambda members, owner, run, runs: diff(members, owner, run, runs).select(owner, run, "change_type", "field", "previous", "current")
