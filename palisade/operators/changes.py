"""Change detection between successive states of one facet of an asset.

Each function maps rows with ``previous`` and ``current`` state structs to (keys, ord, change_type, field, previous,
current); ``ord`` is the position in the reference order, summary first.  Lists appear as '[a, b]' text, so that one column
fits every field.  Nothing is reported on first sight, with the exceptions stated below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade import constants as K
from palisade.functions.common import opaque
from palisade.functions.values import array_text

_TEXT = "string"
_CHANGE = "struct<change_type:string,field:string,previous:string,current:string>"


def _change(kind: Column | str, field: str, previous: Column, current: Column) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("change_type"), F.lit(field).alias("field"),
        previous.cast(_TEXT).alias("previous"), current.cast(_TEXT).alias("current"),
    )


def _one(cond: Column, kind: Column | str, field: str, previous: Column, current: Column) -> Column:
    hit = F.array(_change(kind, field, previous, current))
    return F.when(F.coalesce(cond, F.lit(False)), hit).otherwise(F.array().cast(f"array<{_CHANGE}>"))


def _null() -> Column:
    return F.lit(None).cast(_TEXT)


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))


def _emit(df: DataFrame, keys: Sequence[str], changes: Column) -> DataFrame:
    rows = opaque(df, __changes=changes).select(*keys, F.posexplode("__changes").alias("ord", "c"))
    return rows.select(*keys, "ord", "c.*")


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def diff_dns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State: a, aaaa, cname, mx, ns, txt (text arrays), asn and cloud (text arrays), has_asn, has_cloud.

    ``has_*`` says whether the state was recorded with that enrichment at all."""
    p, c = F.col("previous"), F.col("current")
    records = []
    for record, kind in K.DNS_CHANGES.items():
        f = record.lower()
        a, b = _set(p[f]), _set(c[f])
        records.append(_one(a != b, kind, f"dns.{f}", array_text(a), array_text(b)))
    found = F.concat(*records)
    df = opaque(df, __found=found)
    found = F.col("__found")
    summary = _one(F.size(found) > 0, "DNS_CHANGED", "dns", F.to_json(p), F.to_json(c))
    pa, ca, pc, cc = _set(p["asn"]), _set(c["asn"]), _set(p["cloud"]), _set(c["cloud"])
    pi, ci = _set(F.concat(_set(p["a"]), _set(p["aaaa"]))), _set(F.concat(_set(c["a"]), _set(c["aaaa"])))
    rest = F.concat(
        _one(p["has_asn"] & (F.size(pa) > 0) & (F.size(ca) > 0) & (pa != ca), "ASN_CHANGED", "asn.number", array_text(pa), array_text(ca)),
        _one(p["has_cloud"] & (pc != cc), "CLOUD_PROVIDER_CHANGED", "cloud.provider", array_text(pc), array_text(cc)),
        _one((F.size(pi) > 0) & (F.size(ci) > 0) & (pi != ci), "IP_CHANGED", "dns.ips", array_text(pi), array_text(ci)),
    )
    seen = df.filter(p.isNotNull())
    return _emit(seen, keys, F.concat(summary, found, rest))


def diff_http(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State: status_code, title, webserver, technologies (text array), ip, cdn, asn, cloud, has_asn, has_cloud."""
    p, c = F.col("previous"), F.col("current")
    blank = lambda x: F.coalesce(x, F.lit(""))
    tp, tc = _set(p["technologies"]), _set(c["technologies"])
    added = F.transform(F.array_except(tc, tp), lambda t: _change("TECHNOLOGY_ADDED", "technology.name", _null(), t))
    removed = F.transform(F.array_except(tp, tc), lambda t: _change("TECHNOLOGY_REMOVED", "technology.name", t, _null()))
    given = lambda x: x.isNotNull() & (x.cast(_TEXT) != "") & (x.cast(_TEXT) != "0")
    empty_null = lambda x: F.when(x != "", x)
    changes = F.concat(
        _one(_differs(p["status_code"], c["status_code"]), "HTTP_STATUS_CHANGED", "http.status_code", p["status_code"], c["status_code"]),
        _one(blank(p["title"]) != blank(c["title"]), "TITLE_CHANGED", "http.title", p["title"], c["title"]),
        _one(blank(p["webserver"]) != blank(c["webserver"]), "TECHNOLOGY_CHANGED", "http.webserver", p["webserver"], c["webserver"]),
        added.cast(f"array<{_CHANGE}>"), removed.cast(f"array<{_CHANGE}>"),
        _one(given(p["ip"]) & given(c["ip"]) & (p["ip"] != c["ip"]), "IP_CHANGED", "host.ip", p["ip"], c["ip"]),
        _one(_differs(empty_null(p["cdn"]), empty_null(c["cdn"])), "CLOUD_PROVIDER_CHANGED", "http.cdn", p["cdn"], c["cdn"]),
        _one(p["has_asn"] & given(p["asn"]) & given(c["asn"]) & (p["asn"] != c["asn"]), "ASN_CHANGED", "asn.number", p["asn"], c["asn"]),
        _one(p["has_cloud"] & _differs(empty_null(p["cloud"]), empty_null(c["cloud"])), "CLOUD_PROVIDER_CHANGED", "cloud.provider", p["cloud"], c["cloud"]),
    )
    return _emit(df.filter(p.isNotNull()), keys, changes)


def diff_tls(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State: fingerprint, issuer, san (text array), tls_version, not_after, expiry_status.

    An expiry alert also fires on first sight; it fires once per change of the expiry status."""
    p, c = F.col("previous"), F.col("current")
    known = p.isNotNull()
    kind = F.when(c["expiry_status"] == "expiring", "CERT_EXPIRING").when(c["expiry_status"] == "expired", "CERTIFICATE_EXPIRED")
    alert = _one(
        kind.isNotNull() & _differs(c["expiry_status"], p["expiry_status"]), kind, "tls.not_after", p["expiry_status"], c["not_after"]
    )
    sp, sc = _set(p["san"]), _set(c["san"])
    print_changed = known & _differs(p["fingerprint"], c["fingerprint"])
    facts = F.concat(
        _one(print_changed, "CERT_CHANGED", "tls.fingerprint", p["fingerprint"], c["fingerprint"]),
        _one(print_changed, "FINGERPRINT_CHANGED", "tls.fingerprint", p["fingerprint"], c["fingerprint"]),
        _one(known & _differs(p["issuer"], c["issuer"]), "ISSUER_CHANGED", "tls.issuer", p["issuer"], c["issuer"]),
        _one(known & (sp != sc), "SAN_CHANGED", "tls.san", array_text(sp), array_text(sc)),
        _one(known & _differs(p["tls_version"], c["tls_version"]), "TLS_VERSION_CHANGED", "tls.version", p["tls_version"], c["tls_version"]),
    )
    df = opaque(df, __alert=alert, __facts=facts)
    summary = _one(F.size("__facts") > 0, "TLS_CHANGED", "tls", _null(), _null())
    return _emit(df, keys, F.concat(summary, F.col("__alert"), F.col("__facts")))


def diff_ports(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State: ports (int array).  New ports ascending, then removed ones."""
    p, c = F.col("previous"), F.col("current")
    empty = F.array().cast("array<int>")
    a = F.array_sort(F.array_distinct(F.coalesce(p["ports"], empty)))
    b = F.array_sort(F.array_distinct(F.coalesce(c["ports"], empty)))
    new = F.transform(F.array_except(b, a), lambda x: _change("NEW_PORT", "network.port", _null(), x.cast(_TEXT)))
    gone = F.transform(F.array_except(a, b), lambda x: _change("PORT_REMOVED", "network.port", x.cast(_TEXT), _null()))
    return _emit(df.filter(p.isNotNull()), keys, F.concat(new, gone))


# --- facets whose state is a set too large for one row: one row per member ------------------------------


def _runs_with_previous(members: DataFrame, owner: str, run: str, runs: DataFrame | None) -> DataFrame:
    """(owner, run, prev_run) of every run; runs of an owner are numbered in order.

    ``runs`` lists all runs; a run that found nothing has no members and is only known from there."""
    listed = members.select(owner, run) if runs is None else runs.select(owner, run).union(members.select(owner, run))
    return listed.distinct().withColumn("prev_run", F.lag(run).over(Window.partitionBy(owner).orderBy(run)))


def diff_endpoints(members: DataFrame, owner: str = "origin", run: str = "run", runs: DataFrame | None = None) -> DataFrame:
    """NEW_ENDPOINT rows: endpoints of a crawl missing from the crawl before.  The first crawl is the baseline.

    members: (owner, run, endpoint_hash, endpoint), unique per (owner, run, endpoint_hash); runs: (owner, run) of all crawls."""
    known = _runs_with_previous(members, owner, run, runs)
    now = members.join(known.filter(F.col("prev_run").isNotNull()), [owner, run])
    before = members.select(owner, F.col(run).alias("prev_run"), "endpoint_hash")
    fresh = now.join(before, [owner, "prev_run", "endpoint_hash"], "left_anti")
    return fresh.select(
        owner, run, "endpoint_hash", F.lit("NEW_ENDPOINT").alias("change_type"), F.lit("url.path").alias("field"),
        _null().alias("previous"), F.concat(F.col(owner), F.col("endpoint")).alias("current"),
    )


def diff_findings(members: DataFrame, owner: str = "host", run: str = "run", runs: DataFrame | None = None) -> DataFrame:
    """NEW_FINDING (plus NEW_CRITICAL_FINDING) and FINDING_RESOLVED rows against the scan before; the first scan is the
    baseline, and a scan without findings resolves all.

    members: (owner, run, finding_hash, severity, template_id, url); runs: (owner, run) of all scans."""
    known = _runs_with_previous(members, owner, run, runs).filter(F.col("prev_run").isNotNull())
    label = F.concat("template_id", F.lit(" @ "), "url", F.lit(" ("), "severity", F.lit(")"))
    now = members.join(known, [owner, run])
    before = members.withColumnRenamed(run, "prev_run")
    new = now.join(before.select(owner, "prev_run", "finding_hash"), [owner, "prev_run", "finding_hash"], "left_anti")
    kinds = F.when(
        F.col("severity") == "critical", F.array(F.lit("NEW_FINDING"), F.lit("NEW_CRITICAL_FINDING"))
    ).otherwise(F.array(F.lit("NEW_FINDING")))
    added = new.select(
        owner, run, "finding_hash", F.explode(kinds).alias("change_type"), F.lit("vuln.finding").alias("field"),
        _null().alias("previous"), label.alias("current"),
    )
    gone = before.join(known, [owner, "prev_run"]).join(members.select(owner, run, "finding_hash"), [owner, run, "finding_hash"], "left_anti")
    resolved = gone.select(
        owner, run, "finding_hash", F.lit("FINDING_RESOLVED").alias("change_type"), F.lit("vuln.finding").alias("field"),
        label.alias("previous"), _null().alias("current"),
    )
    return added.unionByName(resolved)


def vulnerability_changes(correlations: DataFrame, programs: DataFrame) -> DataFrame:
    """NEW_CVE for inserted correlations and KEV_ADDED when the CVE is catalogued now and was not before - once per
    in-scope program of the asset (one NULL program when there is none).
    correlations: from ``merge.upsert_correlations``; programs: (asset_id, program_id)."""
    wide = correlations.join(programs, "asset_id", "left")
    kinds = F.array_compact(F.array(
        F.when(F.col("inserted"), "NEW_CVE"), F.when(F.col("in_kev") & ~F.col("was_kev"), "KEV_ADDED")
    ))
    return wide.select("asset_id", "program_id", "cve_id", "source", F.explode(kinds).alias("change_type"))


def scope_blocked(rows: DataFrame, layer: str, keys: Sequence[str]) -> DataFrame:
    """Alert rows for refused targets (``decision`` struct attached by ``operators.scope``)."""
    d = F.col("decision")
    return rows.filter(~d["allowed"]).select(
        *keys, F.lit("SCOPE_BLOCKED").alias("change_type"), F.lit(layer).alias("layer"), d["reason"].alias("reason"),
        F.when(d["match_kind"] == "explicit_exclusion", "excluded").otherwise("out").alias("scope_status"), d["scope_id"].alias("scope_id"),
    )
