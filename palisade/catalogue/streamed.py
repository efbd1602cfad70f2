"""Streams over the given tables, run to the end of what is available; the results are the written tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import schemas
from palisade.catalogue.changing import _LAG
from palisade.catalogue.parsing import EVENT_LINE, _RAW
from palisade.catalogue.platform import POOL, _QUEUES
from palisade.catalogue.registry import register
from palisade.catalogue.scoping import _URLS, _ctes
from palisade.catalogue.standins import _K, spark_sql, standin, table
from palisade.operators import changes
from palisade.session import scratch_dir
from palisade.sources.commits import Store
from palisade.sources.streams import table_stream
from palisade.streaming import certificates, dedupe, route, state
from palisade.streaming.base import read_output


def _folders(spark, name: str) -> dict[str, str]:
    root = scratch_dir(spark, name)
    return {k: f"{root}/{k}" for k in ("input", "state", "output", "checkpoint", "events", "errors")}


def _events(spark, d):
    return table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _event_rows(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_BY_TIME = ["ts < '2024-01-09'", "ts >= '2024-01-09' AND ts < '2024-01-20'", "ts >= '2024-01-20' OR ts IS NULL"]


def _in_parts(rows, parts, folder, run):
    """Let a stream read the rows part by part: each part is added to its folder, and the stream is started again from its checkpoint."""
    for part in parts:
        rows.filter(part).write.mode("append").parquet(folder)
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(folder))


@register("st1_ttl_dedupe", """
    WITH RECURSIVE accepted AS (
        SELECT user_id, min(ts) AS t FROM events GROUP BY user_id
        UNION ALL SELECT * FROM (SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id AND e.ts >= a.t + INTERVAL 5 DAY) AS t FROM accepted a) WHERE t IS NOT NULL)
    SELECT a.user_id, min(e.event_id) AS event_id FROM accepted a JOIN events e ON e.user_id = a.user_id AND e.ts = a.t GROUP BY a.user_id, a.t""")
def st1(spark, d):
    f = _folders(spark, "st1")
    rows = _event_rows(spark, d).select("user_id", "ts", "event_id")
    _in_parts(rows, _BY_TIME, f["input"], lambda stream: dedupe.dedupe_stream(stream, "user_id", "ts", "event_id", 5 * 86400, output=f["output"], checkpoint=f["checkpoint"]))
    return read_output(spark, f["output"], rows.schema).select("user_id", "event_id")


@register("st2_once_per_fact", """
    SELECT fact, event_id FROM (SELECT event_type || '|' || CAST(user_id AS VARCHAR) AS fact, event_id, ts FROM events) QUALIFY row_number() OVER (PARTITION BY fact ORDER BY ts, event_id) = 1""")
def st2(spark, d):
    f = _folders(spark, "st2")
    rows = _event_rows(spark, d).select(F.concat_ws("|", "event_type", "user_id").alias("fact"), "ts", "event_id")
    _in_parts(rows, _BY_TIME, f["input"], lambda stream: dedupe.once_only_stream(stream, "fact", "ts", "event_id", output=f["output"], checkpoint=f["checkpoint"]))
    return read_output(spark, f["output"], rows.schema).select("fact", "event_id")


_CHANGE_SCHEMA = T.StructType([
    T.StructField("asset_id", T.LongType()), T.StructField("facet", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ord", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("change_type", "field", "previous", "current")],
])


@register("st3_state_diff", """
    SELECT asset_id, seq, 'NEW_PORT' AS change_type, CAST(8000 + k % 5 AS VARCHAR) AS port FROM pairs WHERE pk IS NOT NULL AND k % 5 <> pk % 5
    UNION ALL SELECT asset_id, seq, 'PORT_REMOVED', CAST(8000 + pk % 5 AS VARCHAR) FROM pairs WHERE pk IS NOT NULL AND k % 5 <> pk % 5""", {"pairs": _LAG})
def st3(spark, d):
    f = _folders(spark, "st3")
    rows = _event_rows(spark, d).select(
        F.col("user_id").alias("asset_id"), F.lit("ports:bbot").alias("facet"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"),
        F.struct(F.array(F.lit(443), 8000 + F.expr(_K) % 5).alias("ports")).alias("current"),
    )
    # parts out of order, then one row of no asset that lets the watermark pass all others
    last = rows.agg((F.max("observed_at") + F.expr("INTERVAL 100 DAYS")).alias("observed_at"))
    last = last.select(*[F.lit(None).cast(t).alias(c) if c != "observed_at" else F.col(c) for c, t in rows.dtypes])
    _in_parts(rows.unionByName(last), [*(f"asset_id IS NOT NULL AND seq % 3 = {i}" for i in (1, 2, 0)), "asset_id IS NULL"], f["input"],
              lambda stream: state.diff_stream(stream, changes.diff_ports, output=f["output"], checkpoint=f["checkpoint"], delay="60 days"))
    out = read_output(spark, f["output"], _CHANGE_SCHEMA)
    return out.select("asset_id", "seq", "change_type", F.coalesce("current", "previous").alias("port"))


@register("st4_tumbling_buckets", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def st4(spark, d):
    f = _folders(spark, "st4")
    store = Store(spark, f["state"])
    rows = _event_rows(spark, d).select("ts", "event_type")
    _in_parts(rows, _BY_TIME, f["input"], lambda stream: state.upsert_stream(state.bucket_counts(stream, "ts", ["event_type"], "1 hour", "40 days"), "hours", ["bucket", "event_type"], store, checkpoint=f["checkpoint"]))
    return store.table("hours", "bucket timestamp, event_type string, n long").select(F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), "event_type", "n")


# certificates: one per user, logged again and again; hosts of several programs, excluded ones and ones out of scope, and a name shared by half of all
_CT_HOST = "CONCAT('u', CAST(user_id AS STRING), CASE user_id % 5 WHEN 0 THEN '.example.com' WHEN 1 THEN '.example.net' WHEN 2 THEN '.example.org' WHEN 3 THEN '.ththan.example.net' ELSE '.other.test' END)"
_CT_LINE = (
    "CONCAT('{\"message_type\":\"certificate_update\",\"data\":{\"update_type\":\"X509LogEntry\",\"leaf_cert\":{\"subject\":{\"CN\":\"', " + _CT_HOST + ", '\"},\"sha256\":\"', SHA(CAST(user_id AS STRING)), "
    "'\",\"all_domains\":[\"', " + _CT_HOST + ", CASE WHEN user_id % 2 = 0 THEN '\",\"shared.example.com' ELSE '' END, '\"]},\"cert_index\":', CAST(event_id AS STRING), '}}')"
)
_CT_SETS = {
    "ct_names": f"""
        SELECT user_id, event_id, ts, {_CT_HOST.replace('STRING', 'VARCHAR')} AS domain, user_id % 5 AS site FROM events UNION ALL SELECT user_id, event_id, ts, 'shared.example.com', 0 FROM events WHERE user_id % 2 = 0""",
    "ct_pairs": """
        SELECT n.*, p.program_id, p.scope_id FROM ct_names n JOIN (VALUES (0, 'P1', 'r01'), (1, 'P1', 'r03'), (1, 'P2', 'r04'), (2, 'P3', 'r08'), (3, 'P1', 'r03')) p(site, program_id, scope_id) ON n.site = p.site""",
    "ct_taken": """
        SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id FROM (
            SELECT a.user_id, e.event_id, e.ts, a.t FROM (
                WITH RECURSIVE accepted AS (
                    SELECT user_id, min(ts) AS t FROM ct_pairs GROUP BY user_id
                    UNION ALL SELECT * FROM (SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id AND e.ts >= a.t + INTERVAL 5 DAY) AS t FROM accepted a) WHERE t IS NOT NULL)
                SELECT * FROM accepted) a JOIN events e ON e.user_id = a.user_id AND e.ts = a.t) GROUP BY user_id, t""",
    "ct_kept": "SELECT p.* FROM ct_pairs p JOIN ct_taken t ON p.user_id = t.user_id AND p.event_id = t.event_id",
}
_CT_TTL = 5 * 86400


def _ct_run(spark, d, name):
    """Messages in three parts through both streams."""
    f = _folders(spark, name)
    store = Store(spark, f["state"], buckets=8)
    rows = _event_rows(spark, d).selectExpr("event_id AS seq", "ts AS observed_at", spark_sql(f"{_CT_LINE} AS value"))

    def run(messages):
        certificates.match_stream(messages, lambda: standin(spark, d, "rule_rows"), matched=f["output"], outside=f["errors"], checkpoint=f["checkpoint"])
        seen = spark.read.parquet(f"{f['output']}/batch=*").schema
        matched = spark.readStream.schema(seen).parquet(f"{f['output']}/batch=*")
        certificates.certificate_stream(matched, store, checkpoint=f["events"], ttl_seconds=_CT_TTL)

    _in_parts(rows, [x.replace("ts ", "observed_at ") for x in _BY_TIME], f["input"], run)
    return store, f


@register("ob10_ct_stream", """
    SELECT 'CT_CERTIFICATE' AS kind, 'bb-certstream' AS place, domain AS a, program_id AS b, scope_id AS c, 'subdomain' AS d, SHA(CAST(user_id AS VARCHAR)) AS e, event_id AS n, EPOCH(ts) AS first_us, EPOCH(ts) AS last_us FROM ct_kept
    UNION ALL (SELECT 'NEW_SUBDOMAIN', 'bb-changes', domain, program_id, scope_id, 'subdomain', 'tls.san', event_id, EPOCH(ts), EPOCH(ts) FROM ct_kept QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts, event_id, program_id) = 1)
    UNION ALL SELECT DISTINCT 'NEW_CERTIFICATE', 'bb-changes', SHA(CAST(user_id AS VARCHAR)), program_id, NULL, 'certificate', 'tls.fingerprint', event_id, EPOCH(ts), EPOCH(ts)
        FROM (SELECT * FROM ct_kept QUALIFY rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
    UNION ALL SELECT 'asset', 'assets', domain, 'subdomain', NULL, NULL, NULL, NULL, EPOCH(min(ts)), EPOCH(max(ts)) FROM ct_kept GROUP BY domain
    UNION ALL SELECT 'asset', 'assets', SHA(CAST(user_id AS VARCHAR)), 'certificate', NULL, NULL, NULL, NULL, EPOCH(min(ts)), EPOCH(max(ts)) FROM ct_kept GROUP BY user_id
    UNION ALL SELECT 'edge', 'edges', domain, SHA(CAST(user_id AS VARCHAR)), 'DISCOVERED_FROM', NULL, NULL, NULL, EPOCH(min(ts)), EPOCH(max(ts)) FROM ct_kept GROUP BY domain, user_id
    UNION ALL SELECT 'link', 'links', domain, program_id, 'in_scope', NULL, NULL, NULL, EPOCH(min(ts)), EPOCH(max(ts)) FROM ct_kept GROUP BY program_id, domain
    UNION ALL SELECT 'outside', 'outside', SHA(CAST(user_id AS VARCHAR)), NULL, NULL, NULL, NULL, event_id, EPOCH(ts), EPOCH(ts) FROM events WHERE user_id % 5 = 4 AND user_id % 2 = 1""", _CT_SETS)
def ob10_stream(spark, d):
    """What the stream leaves behind: events with fields of their payload, stored assets, edges and links, certificates out of scope."""
    store, f = _ct_run(spark, d, "ob10-stream")
    p = lambda path: F.get_json_object("payload", f"$.{path}")
    none = F.lit(None).cast("string")

    def shown(df, kind, place, a, b, c=none, d=none, e=none, n=F.lit(None).cast("long"), first="first_seen", last="last_seen"):
        texts = [x.alias(y) for x, y in ((kind, "kind"), (place, "place"), (a, "a"), (b, "b"), (c, "c"), (d, "d"), (e, "e"), (n, "n"))]
        return df.select(*texts, F.unix_micros(first).alias("first_us"), F.unix_micros(last).alias("last_us"))

    c = F.col
    parts = [
        shown(store.events("events", schemas.EVENTS), c("type"), c("index"), p("asset.value"), p("program.id"), p("scope.id"), p("asset.type"), F.coalesce(p("change.field"), p("tls.fingerprint")), c("seq"), "ts", "ts"),
        shown(store.table("assets", schemas.ASSETS), F.lit("asset"), F.lit("assets"), c("value"), c("asset_type")),
        shown(store.table("edges", schemas.EDGES), F.lit("edge"), F.lit("edges"), c("source_id"), c("target_id"), c("relationship_type")),
        shown(store.table("links", schemas.LINKS), F.lit("link"), F.lit("links"), c("asset_id"), c("program_id"), c("status")),
        shown(spark.read.parquet(f"{f['errors']}/batch=*"), F.lit("outside"), F.lit("outside"), c("fingerprint"), none, n=c("seq"), first="observed_at", last="observed_at"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


@register("st5_route", """
    SELECT idx AS index, error_type, CAST(count(*) AS BIGINT) AS n, true AS has_ingest_time FROM raw_events GROUP BY ALL""", {"raw_events": _RAW})
def st5(spark, d):
    f = _folders(spark, "st5")
    lines = table_stream(spark, d, "events").selectExpr("event_id", f"{EVENT_LINE} AS value")
    route.route_stream(lines, None, events=f["events"], errors=f["errors"], checkpoint=f["checkpoint"])
    both = spark.read.parquet(f"{f['events']}/batch=*").unionByName(spark.read.parquet(f"{f['errors']}/batch=*"))
    return both.groupBy("index", "error_type").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("ingested").isNotNull()).alias("has_ingest_time"))


@register("st6_dead_letters", """
    SELECT event_id, 'bb-errors' AS index, 'ELASTICSEARCH_REJECTED' AS error_type, 'reason ' || event_type AS error_message, length(repeat(props, 800)) AS kept FROM events""")
def st6(spark, d):
    f = _folders(spark, "st6")
    rejected = table_stream(spark, d, "events").selectExpr("event_id", "repeat(props, 800) AS payload", "'reason ' || event_type AS reason", "'changes' AS pipeline")
    stream = route.dead_letter_stream(rejected)
    query = stream.writeStream.format("parquet").option("path", f["output"]).option("checkpointLocation", f["checkpoint"]).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f["output"]).select("event_id", "index", "error_type", "error_message", F.length("original").alias("kept"))


@register("st7_scoped_stream", """
    SELECT h.page_id, COALESCE(d.allowed, false) AS allowed FROM http_obs h LEFT JOIN scope_decided d ON h.url = d.target AND d.program_id = 'P1'""", _ctes(_URLS))
def st7(spark, d):
    f = _folders(spark, "st7")
    stream = table_stream(spark, d, "pages").select("page_id", F.col("url").alias("target"), F.lit("P1").alias("program_id"))
    route.scoped_stream(stream, lambda: standin(spark, d, "rule_rows"), output=f["output"], checkpoint=f["checkpoint"])
    return spark.read.parquet(f"{f['output']}/batch=*").select("page_id", "decision.allowed")


@register("st8_metric_stream", """
    SELECT (SELECT strftime(max(ts), '%Y-%m-%d %H') FROM events) AS tick, queue AS queue_name, pending, workers, busy_workers FROM pool""", {"queues": _QUEUES, "pool": POOL})
def st8(spark, d):
    f = _folders(spark, "st8")
    route.queue_metric_stream(
        _events(spark, d).select("ts"), lambda: standin(spark, d, "jobs"), lambda: standin(spark, d, "workers"), output=f["output"], checkpoint=f["checkpoint"]
    )
    out = spark.read.parquet(f"{f['output']}/batch=*")
    return out.select(F.date_format("ts", "yyyy-MM-dd HH").alias("tick"), "queue_name", "pending", "workers", "busy_workers")
