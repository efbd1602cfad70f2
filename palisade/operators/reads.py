"""List and detail reads over the platform tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.common import literal_table
from palisade.operators.ranking import cap_per_group
from palisade.operators.scope import with_decision


def list_assets(
    assets: DataFrame, links: DataFrame | None = None, *, program: object = None, asset_type: str | None = None,
    status: str | None = None, q: str | None = None, limit: int, offset: int = 0,
) -> DataFrame:
    """Newest first, optionally of one program, one type, one status, containing a text."""
    out = assets
    if program is not None:
        out = out.join(links.filter(F.col("program_id") == program).select("asset_id").distinct(), "asset_id", "left_semi")
    if asset_type is not None:
        out = out.filter(F.col("asset_type") == asset_type)
    if status is not None:
        out = out.filter(F.col("status") == status)
    if q is not None:
        out = out.filter(F.col("value").contains(q.lower()))
    return out.orderBy(F.desc("last_seen"), F.asc("asset_id")).offset(offset).limit(limit)


def asset_detail(assets: DataFrame, links: DataFrame, states: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Asset with its program links and facet states, one row per link or state: (asset_id, asset_type, value, section,
    key, detail).  Rows stay long: an asset may have any number of facets."""
    base = assets if ids is None else assets.join(ids.select("asset_id").distinct(), "asset_id", "left_semi")
    base = base.select("asset_id", "asset_type", "value")
    programs = links.select("asset_id", F.lit("program").alias("section"), F.col("program_id").cast("string").alias("key"), F.col("status").alias("detail"))
    facets = states.select("asset_id", F.lit("state").alias("section"), F.col("facet").alias("key"), F.col("state").alias("detail"))
    return base.join(programs.unionByName(facets), "asset_id", "left")


def list_scope(scope: DataFrame, program: object) -> DataFrame:
    """Active entries of a program: excludes after includes (mode descending), then type and value."""
    return scope.filter((F.col("program_id") == program) & F.col("active")).orderBy(F.desc("mode"), "type", "value")


def list_programs(programs: DataFrame, active_only: bool = False) -> DataFrame:
    alive = programs.filter(F.col("deleted_at").isNull())
    return (alive.filter(F.col("active")) if active_only else alive).orderBy("slug")


def list_scans(scans: DataFrame, program: object = None, *, limit: int) -> DataFrame:
    out = scans if program is None else scans.filter(F.col("program_id") == program)
    return out.orderBy(F.desc("created_at"), "scan_id").limit(limit)


def scan_detail(jobs: DataFrame) -> DataFrame:
    """Job counts by status of every scan."""
    return jobs.groupBy("scan_id", "status").agg(F.count(F.lit(1)).alias("jobs"))


def list_jobs(
    jobs: DataFrame, *, status: str | None = None, scanner: str | None = None, scan: object = None, program: object = None, limit: int
) -> DataFrame:
    out = jobs
    for name, value in (("status", status), ("scanner", scanner), ("scan_id", scan), ("program_id", program)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out.orderBy(F.desc("created_at"), "job_id").limit(limit)


def list_audit(audit: DataFrame, action: str | None = None, *, limit: int) -> DataFrame:
    out = audit if action is None else audit.filter(F.col("action") == action)
    return out.orderBy(F.desc("ts"), "audit_id").limit(limit)


def list_deliveries(deliveries: DataFrame, status: str | None = None, *, limit: int) -> DataFrame:
    out = deliveries if status is None else deliveries.filter(F.col("status") == status)
    return out.orderBy(F.desc("created_at"), "delivery_id").limit(limit)


def list_windows(windows: DataFrame, *, limit: int) -> DataFrame:
    return windows.orderBy(F.desc("start"), "window_id").limit(limit)


def open_windows(windows: DataFrame, t: Column) -> DataFrame:
    """Maintenance windows containing a moment: start included, end not."""
    return windows.filter((F.col("start") <= t) & (F.col("end") > t))


def due_schedules(schedules: DataFrame, t: Column) -> DataFrame:
    return schedules.filter(F.col("enabled") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= t)))


def neighbours(edges: DataFrame, assets: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Edges touching each asset with the asset at the other end: (asset_id, direction, relationship_type, other_id,
    other_type, other_value)."""
    side = lambda a, b, d: edges.select(
        F.col(a).alias("asset_id"), F.lit(d).alias("direction"), "relationship_type", F.col(b).alias("other_id")
    )
    both = side("source_id", "target_id", "outgoing").unionByName(side("target_id", "source_id", "incoming"))
    if ids is not None:
        both = both.join(ids.select("asset_id").distinct(), "asset_id", "left_semi")
    other = assets.select(F.col("asset_id").alias("other_id"), F.col("asset_type").alias("other_type"), F.col("value").alias("other_value"))
    return both.join(other, "other_id", "inner")


def program_targets(
    assets: DataFrame, links: DataFrame, rules: DataFrame, *, kind: str = "host", program: object = None, limit: int | None = None
) -> DataFrame:
    """Scannable targets whose membership says in scope, checked against the scope again; ``skipped`` marks those that no longer pass.

    ``limit``: at most so many passing targets of each program, newest first; those that fail the check do not count."""
    types = {"url": ("url",), "host": ("domain", "subdomain", "ipv4", "ipv6")}[kind]
    member = links.filter(F.col("status") == "in_scope")
    if program is not None:
        member = member.filter(F.col("program_id") == program)
    usable = assets.filter(
        F.col("asset_type").isin(*types) & ~F.col("paused") & ~F.col("status").isin("retired", "blocked")
    ).select("asset_id", "value", "last_seen")
    rows = member.select("program_id", "asset_id").join(usable, "asset_id")
    checked = with_decision(rows, rules, "value", "program_id")
    if limit is not None:
        passing = cap_per_group(checked.filter("decision.allowed"), ["program_id"], [F.desc("last_seen"), F.asc("asset_id")], limit)
        checked = passing.unionByName(checked.filter("NOT decision.allowed"))
    return checked.select("program_id", "asset_id", "value", (~F.col("decision.allowed")).alias("skipped"))


def schedule_targets(
    schedules: DataFrame, programs: DataFrame, assets: DataFrame, links: DataFrame, cap: int | None = None
) -> DataFrame:
    """(schedule_id, program_id, scanner, asset_id): in-scope, unpaused assets of the kinds each scanner accepts; with ``cap``, at
    most so many per schedule, program and scanner.  A schedule without program covers every active one.

    schedules: (schedule_id, program_id, scanners array)."""
    accepted = [
        (s, t) for s, (_, kinds) in sorted(K.SCANNERS.items()) for t in sorted({*kinds, *(["subdomain"] if "domain" in kinds else [])})
    ]
    accepts = literal_table(schedules.sparkSession, accepted, "scanner string, asset_type string")
    usable = programs.filter(F.col("active") & F.col("deleted_at").isNull()).select("program_id")
    runs = schedules.select("schedule_id", F.col("program_id").alias("__p"), F.explode(F.array_distinct("scanners")).alias("scanner"))
    given = runs.filter(F.col("__p").isNotNull()).withColumnRenamed("__p", "program_id").join(usable, "program_id", "left_semi")
    every = runs.filter(F.col("__p").isNull()).drop("__p")
    members = (
        links.filter(F.col("status") == "in_scope").join(usable, "program_id", "left_semi").select("program_id", "asset_id").distinct()
        .join(assets.filter(~F.col("paused")).select("asset_id", "asset_type"), "asset_id")
        .join(F.broadcast(accepts), "asset_type")
    )
    # members of a (program, scanner) beyond the cap can never be chosen; cut them before schedules multiply the rows
    few = members if cap is None else cap_per_group(members, ["program_id", "scanner"], [F.asc("asset_id")], cap)
    few = few.select("program_id", "scanner", "asset_id")
    of_given = given.join(few, ["program_id", "scanner"])
    of_every = every.join(few, ["scanner"])
    columns = ["schedule_id", "program_id", "scanner", "asset_id"]
    return of_given.select(*columns).unionByName(of_every.select(*columns))
