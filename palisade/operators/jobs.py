"""Planning, recovery and reporting over the job table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.addresses import cidr_size
from palisade.functions.common import epoch_seconds, literal_table, sha256
from palisade.functions.targets import classify
from palisade.operators.skew import lookup_join
from palisade.sources.events import build_event


def scanner_kinds(spark) -> DataFrame:
    """(scanner, kinds) of the registry."""
    return literal_table(spark, [(s, list(k)) for s, (_, k) in sorted(K.SCANNERS.items())], "scanner string, kinds array<string>")


def guards(plan: DataFrame, programs: DataFrame, controls: DataFrame, assets: DataFrame, windows: DataFrame, now: Column) -> DataFrame:
    """Add ``guard``: the first operational reason against a job - program, scanner, asset, maintenance window - or NULL.

    plan: (job_id, program_id, scanner, asset_id, ...); controls: (scanner, paused); windows with NULL = any."""
    p = programs.select("program_id", (F.col("active") & F.col("deleted_at").isNull()).alias("__live"))
    c = controls.filter("paused").select("scanner", F.lit(True).alias("__paused"))
    a = assets.select("asset_id", (F.col("paused") | F.col("status").isin("blocked", "retired")).alias("__held"))
    out = lookup_join(plan, p, ["program_id"], "left")
    out = lookup_join(out, c, ["scanner"], "left")
    out = out.join(a, "asset_id", "left")
    # a window names any subset of program, scanner and asset: one equi-join per combination that occurs
    live = windows.filter((F.col("start") <= now) & (F.col("end") > now)).select(
        F.col("program_id").cast("string").alias("__wp"), F.col("scanner").alias("__ws"), F.col("asset_id").cast("string").alias("__wa")
    ).distinct()
    star = "*"
    keyed = live.select(
        F.concat_ws("|", *[F.coalesce(c, F.lit(star)) for c in ("__wp", "__ws", "__wa")]).alias("__wkey")
    ).distinct().withColumn("__window", F.lit(True))
    parts = [F.col("program_id").cast("string"), F.col("scanner"), F.col("asset_id").cast("string")]
    # mask 0 is a window for everything: one boolean, not a join
    flags = keyed.filter(F.col("__wkey") == "*|*|*").agg(F.count(F.lit(1)) > 0).scalar()
    for mask in range(1, 8):
        key = F.concat_ws("|", *[(F.coalesce(v, F.lit("-")) if mask >> i & 1 else F.lit(star)) for i, v in enumerate(parts)])
        side = keyed.select("__wkey", F.lit(True).alias(f"__w{mask}"))
        out = lookup_join(out.withColumn("__wkey", key), side, ["__wkey"], "left").drop("__wkey")
        hit = F.coalesce(F.col(f"__w{mask}"), F.lit(False))
        flags = flags | hit
    reason = (
        F.when(~F.coalesce("__live", F.lit(False)), "PROGRAM_INACTIVE").when(F.coalesce("__paused", F.lit(False)), "SCANNER_PAUSED")
        .when(F.coalesce("__held", F.lit(False)), "ASSET_PAUSED").when(flags, "MAINTENANCE_WINDOW")
    )
    return out.withColumn("guard", reason).drop("__live", "__paused", "__held", *[f"__w{m}" for m in range(1, 8)])


def plan(targets: DataFrame, scanners: DataFrame, decisions: DataFrame, enabled: Column | None = None, max_cidr: int = K.MAX_CIDR_SIZE) -> DataFrame:
    """Target x scanner jobs with status PENDING, or the first failing check in order: invalid target, scope, unsupported
    kind, policy, network size.  (Operational guards: apply ``guards`` to the PENDING rows, then ``apply_guards``.)

    targets: (program_id, target, asset_id); scanners: (scanner) - a handful of requested ones; decisions: from
    ``evaluate_scope`` for the same pairs; ``enabled``: policy switch as a column over the scanner."""
    spec = scanners.join(F.broadcast(scanner_kinds(scanners.sparkSession)), "scanner").agg(
        F.collect_list(F.struct("scanner", "kinds")).alias("__specs")  # one entry per requested scanner
    )
    classified = classify(targets.select("target").distinct(), "target", "__t")
    facts = classified.select(
        "target", F.col("__t.kind").alias("target_type"), F.col("__t.value").alias("value"), F.col("__t.error").alias("error"),
        cidr_size(F.col("__t.net_bits"), F.col("__t.ip_version")).alias("addresses"),
    )
    verdict = decisions.select("target", "program_id", "allowed", "match_kind", "reason", "scope_id")
    rows = targets.join(facts, "target").join(verdict, ["target", "program_id"], "left")
    specs = spec.first()["__specs"]  # the registry's few scanners
    listed = F.array(*[F.struct(F.lit(s["scanner"]).alias("scanner"), F.array(*map(F.lit, s["kinds"])).alias("kinds")) for s in specs])
    jobs = rows.withColumn("__s", F.explode(listed)).withColumns({"scanner": F.col("__s.scanner"), "__kinds": F.col("__s.kinds")})
    on = F.lit(True) if enabled is None else enabled
    reason = (
        F.when(F.col("error").isNotNull(), "INVALID_TARGET")
        .when(~F.coalesce("allowed", F.lit(False)), F.when(F.col("match_kind") == "explicit_exclusion", "EXCLUDED").otherwise("NOT_IN_SCOPE"))
        .when(~F.array_contains("__kinds", F.col("target_type")), "UNSUPPORTED_TARGET")
        .when(~on, "POLICY_DISABLED")
        .when((F.col("target_type") == "cidr") & (F.col("addresses") > max_cidr), "CIDR_LIMIT_EXCEEDED")
    )
    jobs = jobs.withColumn("block_reason", reason)
    status = F.when(F.col("block_reason").isNull(), "PENDING").when(
        F.col("block_reason").isin("EXCLUDED", "NOT_IN_SCOPE"), "OUT_OF_SCOPE"
    ).otherwise("BLOCKED")
    return jobs.select(
        "program_id", "target", "asset_id", "scanner", F.coalesce("value", "target").alias("value"), "target_type", "scope_id",
        status.alias("status"), "block_reason",
    )


def apply_guards(planned: DataFrame) -> DataFrame:
    """Turn PENDING rows with a ``guard`` into BLOCKED ones."""
    held = (F.col("status") == "PENDING") & F.col("guard").isNotNull()
    return planned.withColumns(
        {"block_reason": F.when(held, F.col("guard")).otherwise(F.col("block_reason")), "status": F.when(held, "BLOCKED").otherwise(F.col("status"))}
    ).drop("guard")


def idempotency_key(program: Column, target: Column, scanner: Column, policy: Column, now: Column, bucket: Column | int, nonce: Column | None = None) -> Column:
    """Equal for equal requests within one time bucket; a nonce makes it unique."""
    slot = F.floor(epoch_seconds(now) / (F.lit(bucket) if isinstance(bucket, int) else bucket)).cast("string")
    parts = [program.cast("string"), target, scanner, F.coalesce(policy.cast("string"), F.lit("-")), slot]
    return sha256(F.concat_ws("|", *parts, *([nonce] if nonce is not None else [])))


def dedupe_plan(planned: DataFrame, key: str = "idempotency_key", seq: str = "seq") -> DataFrame:
    """Add ``duplicate``: true for every row but the first with the same key.  Rows without key are never duplicates."""
    first = planned.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias("__first"))
    joined = planned.join(first, key, "left")
    return joined.withColumn("duplicate", F.coalesce(F.col(seq) > F.col("__first"), F.lit(False))).drop("__first")


def stuck_jobs(jobs: DataFrame, workers: DataFrame, now: Column) -> DataFrame:
    """Jobs to recover: running ones whose worker is gone (or that exceed the grace period) are retried or failed, stale
    queued ones reset.  (job_id, action, new_status, new_retry_count, next_attempt_at)."""
    t = now.cast("timestamp")
    ago = lambda s: t - F.make_interval(secs=F.lit(s))
    live = workers.select("worker_id").distinct().withColumn("__alive", F.lit(True))
    running = jobs.filter((F.col("status") == "RUNNING") & (F.col("started_at") < ago(K.HEARTBEAT_SECONDS * 4)))
    running = lookup_join(running, live, ["worker_id"], "left")
    fine = F.coalesce("__alive", F.lit(False)) & (F.col("started_at") > ago(K.MAX_SCAN_SECONDS + 300))
    lost = running.filter(~fine)
    again = F.col("retry_count") < F.col("max_retries")
    recovered = lost.select(
        "job_id", F.when(again, "retry").otherwise("fail").alias("action"), F.when(again, "PENDING").otherwise("FAILED").alias("new_status"),
        F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).cast("int").alias("new_retry_count"),
        F.when(again, t + F.make_interval(secs=F.lit(K.RETRY_BASE_SECONDS))).alias("next_attempt_at"),
    )
    stale = jobs.filter((F.col("status") == "QUEUED") & (F.col("queued_at") < ago(K.STALE_QUEUED_SECONDS))).select(
        "job_id", F.lit("reset").alias("action"), F.lit("PENDING").alias("new_status"),
        F.col("retry_count").cast("int").alias("new_retry_count"), F.lit(None).cast("timestamp").alias("next_attempt_at"),
    )
    return recovered.unionByName(stale)


def retry_plan(failures: DataFrame, base: int = K.RETRY_BASE_SECONDS) -> DataFrame:
    """Retry with exponential delay, or dead letter when permanent or exhausted; a full event backlog always retries.

    failures: (job_id, retry_count, max_retries, permanent, backlog_full)."""
    again = F.col("backlog_full") | (~F.col("permanent") & (F.col("retry_count") < F.col("max_retries")))
    delay = F.lit(base) * F.pow(F.lit(2), F.col("retry_count")).cast("long")
    return failures.withColumns(
        {
            "outcome": F.when(again, "retry").otherwise("dead_letter"),
            "new_status": F.when(again, "PENDING").otherwise("FAILED"),
            "new_retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
            "delay_seconds": F.when(again, delay),
        }
    )


def replayable(dead_letters: DataFrame, jobs: DataFrame, *, limit: int) -> DataFrame:
    """The oldest ``limit`` dead letters of each queue, marked replayed when their job is still FAILED, else skipped.

    dead_letters: (queue, position, job_id); smaller positions are older."""
    from palisade.operators.ranking import cap_per_group

    taken = cap_per_group(dead_letters, ["queue"], [F.asc("position")], limit)
    state = jobs.select("job_id", F.col("status").alias("__status"))
    return taken.join(state, "job_id", "left").withColumn(
        "outcome", F.when(F.col("__status") == "FAILED", "replayed").otherwise("skipped")
    ).drop("__status")


def feasible(selection: DataFrame, share: float = K.FEASIBLE_DEADLINE_SHARE) -> DataFrame:
    """Can a template selection finish?  Each template sends at least one request, so templates / rate is a lower bound
    held against a share of the deadline.  selection: (templates, rate_limit, deadline_seconds)."""
    needed = F.col("templates") / F.col("rate_limit")
    budget = F.col("deadline_seconds") * share
    verdict = F.when(F.col("templates") == 0, "no_templates").when(needed > budget, "too_slow").otherwise("ok")
    return selection.withColumns({"needed_seconds": needed, "budget_seconds": budget, "verdict": verdict})


def job_docs(jobs: DataFrame) -> DataFrame:
    """Current-state documents of jobs, id = job id, with the duration once finished."""
    duration = epoch_seconds(F.col("finished_at")) - epoch_seconds(F.col("started_at"))
    return build_event(
        jobs.withColumn("__dur", duration), index="bb-jobs", kind="state", category="job",
        type_=F.concat(F.lit("JOB_"), F.col("status")), ts=F.col("created_at").cast("timestamp"), doc_id=F.col("job_id").cast("string"),
        context={
            "program": {"id": F.col("program_id").cast("string")},
            "scan": {"id": F.col("scan_id").cast("string"), "job_id": F.col("job_id").cast("string"), "tool": F.col("scanner")},
            "source": {"name": F.lit("orchestrator"), "type": F.lit("system")},
        },
        body={
            "job": {
                "id": F.col("job_id").cast("string"), "status": F.col("status"), "scanner": F.col("scanner"), "priority": F.col("priority"),
                "block_reason": F.col("block_reason"), "retry_count": F.col("retry_count"), "duration_seconds": F.col("__dur"),
            }
        },
        keep=["job_id", F.col("__dur").alias("duration_seconds")],
    )


def queue_metrics(jobs: DataFrame, workers: DataFrame, now: Column) -> DataFrame:
    """QUEUE_DEPTH metric rows of one tick."""
    from palisade.operators.aggregates import pool_report

    pool = pool_report(jobs, workers, now)
    return pool.select(
        now.alias("ts"), F.lit("bb-jobs").alias("index"), F.lit("QUEUE_DEPTH").alias("type"), F.col("queue").alias("queue_name"),
        "pending", "workers", "busy_workers",
    )
