"""Streams over several micro-batches give what one batch gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palisade import schemas
from palisade.operators import changes, merge, scope
from palisade.plans.base import pair_states
from palisade.session import scratch_dir
from palisade.sources.commits import Batch, Store
from palisade.sources.events import _fs
from palisade.streaming import certificates, dedupe, route, state
from palisade.streaming.base import read_output


@pytest.fixture(scope="module")
def pieces(spark):
    """Events cut by time into files that are read one per micro-batch, in order."""
    root = scratch_dir(spark, "pieces")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    import time

    for i, (lo, hi) in enumerate(((1, 8), (8, 15), (15, 32))):
        ev.filter(F.dayofmonth("ts").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.1)  # files are taken in order of their modification time
    return ev, spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(root)


def folders(spark, name):
    root = scratch_dir(spark, name)
    return {k: f"{root}/{k}" for k in ("state", "output", "checkpoint")}


def test_ttl_dedupe_across_batches(spark, pieces):
    ev, stream = pieces
    f = folders(spark, "t1")
    f.pop("state")
    cols = ["user_id", "ts", "event_id"]
    dedupe.dedupe_stream(stream.select(*cols), "user_id", "ts", "event_id", 4 * 86400, **f)
    got = {tuple(r) for r in read_output(spark, f["output"], ev.select(*cols).schema).collect()}
    want, last = set(), {}
    for r in ev.select(*cols).orderBy("ts", "event_id").collect():
        if r["user_id"] not in last or (r["ts"] - last[r["user_id"]]).total_seconds() >= 4 * 86400:
            last[r["user_id"]] = r["ts"]
            want.add(tuple(r))
    assert got == want


def test_once_only_across_batches(spark, pieces):
    ev, stream = pieces
    f = folders(spark, "t2")
    f.pop("state")
    cols = ["user_id", "ts", "event_id"]
    dedupe.once_only_stream(stream.select(*cols), "user_id", "ts", "event_id", **f)
    got = {r["event_id"] for r in read_output(spark, f["output"], ev.select(*cols).schema).collect()}
    assert got == {r["e"] for r in ev.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}


def test_state_diff_of_late_rows(spark):
    """Shuffled micro-batches give what one batch in order gives; what the watermark has not passed yet waits."""
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    states = ev.select(F.col("user_id").alias("asset_id"), F.lit("ports").alias("facet"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"), F.struct(F.array((F.col("event_id") % 5).cast("int")).alias("ports")).alias("current"))
    end = spark.createDataFrame([(None, None, "2025-01-01", None, None)], "asset_id long, facet string, t string, seq long, current struct<ports:array<int>>")
    end = end.select("asset_id", "facet", F.col("t").cast("timestamp").alias("observed_at"), "seq", "current")
    f, root = folders(spark, "t3"), scratch_dir(spark, "late")
    f.pop("state")
    batch = changes.diff_ports(pair_states(states), ["asset_id", "facet", "seq"])
    sizes = []
    for part in [*(states.filter(F.col("seq") % 4 == i) for i in (2, 0, 3, 1)), end]:
        part.write.mode("append").parquet(root)
        state.diff_stream(spark.readStream.schema(states.schema).parquet(root), changes.diff_ports, delay="60 days", **f)
        sizes.append(read_output(spark, f["output"], batch.schema).count())
    assert sizes[:-1] == [0, 0, 0, 0] and sizes[-1] > 0
    assert sorted(map(str, read_output(spark, f["output"], batch.schema).collect())) == sorted(map(str, batch.collect()))


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "k long, n long")


def add_up(cur, new):
    return merge.merge(cur, new, ["k"], {"n": merge.LAST}, ["n"])


def test_a_batch_rewrites_the_buckets_of_its_keys(spark):
    store = Store(spark, scratch_dir(spark, "store"), buckets=16)

    def commit(number, pairs, events=()):
        batch = store.batch(number)
        out = batch.merge("t", "k long, n long", ["k"], rows_of(spark, pairs), add_up)
        batch.append("e", rows_of(spark, list(events)))
        return batch, out

    first, out = commit(0, [(k, 0) for k in range(500)], [(1, 1)])
    assert store.table("t", "k long, n long").count() == 0 and store.events("e", "k long, n long").count() == 0  # nothing before the commit
    assert first.commit() and len(first.touched["t"]) == 16 and out.filter("inserted").count() == 500
    before = store.manifest()["keyed"]["t"]["paths"]
    second, out = commit(1, [(k, 1) for k in range(495, 505)], [(2, 2)])
    assert len(second.touched["t"]) <= 10 and out.filter("inserted").count() == 5
    assert second.commit()
    after = store.manifest()["keyed"]["t"]["paths"]
    assert {b for b in after if before[b] != after[b]} == {str(b) for b in second.touched["t"]}
    assert {r.k: r.n for r in store.table("t", "k long, n long").collect()} == {k: int(k >= 495) for k in range(505)}
    # a retry, and an attempt that came too late, change nothing
    assert store.has(1)
    again, _ = commit(1, [(0, 9)], [(3, 3)])
    assert not again.commit()
    assert {tuple(r) for r in store.events("e", "k long, n long").collect()} == {(1, 1), (2, 2)}
    assert store.table("t", "k long, n long").filter("n = 9").count() == 0
    # what a batch replaced goes with the commit after it
    third, _ = commit(2, [(k, 2) for k in range(500)])
    assert third.commit()
    fs, path, hadoop = _fs(spark, store.root)
    assert not any(fs.exists(hadoop.Path(p)) for b, p in before.items() if before[b] != after[b]) and all(fs.exists(hadoop.Path(p)) for p in after.values())
    assert store.table("t", "k long, n long").count() == 505


def ct_lines(spark, rows):
    line = '{{"message_type":"certificate_update","data":{{"leaf_cert":{{"sha256":"{}","all_domains":[{}]}},"cert_index":{}}}}}'
    data = [(i, t, line.format(fp, ",".join(f'"{n}"' for n in names), i)) for i, t, fp, names in rows]
    return spark.createDataFrame([*data, (99, rows[0][1], "{broken"), (98, rows[0][1], '{"message_type":"heartbeat"}')], "seq long, t string, value string").select("seq", F.col("t").cast("timestamp").alias("observed_at"), "value")


def test_certificate_stream_is_once_and_whole(spark):
    """Duplicates within the time to live are dropped after the scope match, refusals do not extend it, a batch that failed before its commit leaves nothing."""
    rules = lambda: spark.createDataFrame([("r1", "P1", "wildcard", "include", "*.example.com"), ("r2", "P2", "domain", "include", "a.example.com")], "rule_id string, program_id string, type string, mode string, value string")
    root, matched = scratch_dir(spark, "ct-in"), scratch_dir(spark, "ct-matched")
    store, f = Store(spark, scratch_dir(spark, "ct-store"), buckets=4), folders(spark, "ct")
    parts = [
        [(1, "2024-01-01 00:00:00", "aa", ["a.example.com", "other.test"]), (2, "2024-01-01 10:00:00", "aa", ["a.example.com"]), (3, "2024-01-01 11:00:00", "bb", ["other.test"])],
        [(4, "2024-01-01 23:00:00", "aa", ["a.example.com"]), (5, "2024-01-01 23:30:00", "cc", ["a.example.com", "b.example.com"])],
        [(6, "2024-01-02 00:00:00", "aa", ["a.example.com"]), (7, "2024-01-02 01:00:00", "bb", ["b.example.com"])],
    ]
    real = Batch.commit
    for i, part in enumerate(parts):
        ct_lines(spark, part).write.mode("append").parquet(root)
        stream = spark.readStream.schema("seq long, observed_at timestamp, value string").parquet(root)
        certificates.match_stream(stream, rules, matched=matched, checkpoint=f["checkpoint"])
        schema = spark.read.parquet(f"{matched}/batch=*").schema
        run = lambda: certificates.certificate_stream(spark.readStream.schema(schema).parquet(f"{matched}/batch=*"), store, checkpoint=f["output"])  # noqa: B023, E731
        if i == 1:
            Batch.commit = lambda self: 1 / 0
            try:
                with pytest.raises(Exception, match="division"):
                    run()
            finally:
                Batch.commit = real
            assert store.batches() == done
        run()
        done = store.batches()
    events = store.events("events", schemas.EVENTS)
    got = sorted((r.seq, r.type, r.p, r.v) for r in events.select("seq", "type", F.get_json_object("payload", "$.program.id").alias("p"), F.get_json_object("payload", "$.asset.value").alias("v")).collect())
    a, b = "a.example.com", "b.example.com"
    assert got == sorted([
        (1, "CT_CERTIFICATE", "P1", a), (1, "CT_CERTIFICATE", "P2", a), (1, "NEW_SUBDOMAIN", "P1", a), (1, "NEW_CERTIFICATE", "P1", "aa"), (1, "NEW_CERTIFICATE", "P2", "aa"),
        (5, "CT_CERTIFICATE", "P1", a), (5, "CT_CERTIFICATE", "P2", a), (5, "CT_CERTIFICATE", "P1", b), (5, "NEW_SUBDOMAIN", "P1", b), (5, "NEW_CERTIFICATE", "P1", "cc"), (5, "NEW_CERTIFICATE", "P2", "cc"),
        (6, "CT_CERTIFICATE", "P1", a), (6, "CT_CERTIFICATE", "P2", a), (7, "CT_CERTIFICATE", "P1", b), (7, "NEW_CERTIFICATE", "P1", "bb"),
    ])
    assets = {r.value: (str(r.first_seen), str(r.last_seen)) for r in store.table("assets", schemas.ASSETS).collect()}
    assert assets[a] == ("2024-01-01 00:00:00", "2024-01-02 00:00:00") and set(assets) == {a, b, "aa", "bb", "cc"}


def test_unchanged_rules_are_keyed_once(spark, monkeypatch):
    """Ten batches with the same rules write one table of keys; an edited rule counts from the next batch on, and the old table goes."""
    made, keep = [], scope.scratch_dir
    monkeypatch.setattr(scope, "scratch_dir", lambda s, name: made.append(keep(s, name)) or made[-1])
    rows = [("r1", "P", "wildcard", "include", "*.kettle.example")]
    root, f = scratch_dir(spark, "rule-targets"), folders(spark, "rules")
    for i in range(10):
        spark.createDataFrame([(i, f"h{i}.kettle.example", "P")], "n long, target string, program_id string").coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema("n long, target string, program_id string").option("maxFilesPerTrigger", 1).parquet(root)
    calls = []

    def read():
        calls.append(1)
        now = rows if len(calls) < 9 else [*rows, ("r2", "P", "domain", "exclude", "kettle.example")]
        return spark.createDataFrame(now, "rule_id string, program_id string, type string, mode string, value string")

    route.scoped_stream(stream, read, output=f["output"], checkpoint=f["checkpoint"])
    fs, _, hadoop = _fs(spark, root)
    assert len(calls) == 10 and len(made) == 2 and [fs.exists(hadoop.Path(p)) for p in made] == [False, True]
    assert sorted(r.allowed for r in spark.read.parquet(f"{f['output']}/batch=*").select("decision.allowed").collect()) == [False] * 2 + [True] * 8


def test_unusable_rules_fail_closed(spark):
    bad = lambda: spark.createDataFrame([("r", "P", "domain", "include", "not a domain")], "rule_id string, program_id string, type string, mode string, value string")
    with pytest.raises(route.RulesUnavailable):
        route.load_rules(bad)

    def missing():
        return spark.read.parquet("/nonexistent/rules")

    with pytest.raises(route.RulesUnavailable):
        route.load_rules(missing)
