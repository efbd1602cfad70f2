"""Operators against brute force on small inputs, hot keys included."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from palisade.functions.addresses import normalize_cidrs, with_ip_bits
from palisade.functions.common import literal_table
from palisade.operators import changes, enrich, merge, ranking, skew, sync, vuln
from palisade.sources import certificates, events, records
from palisade.session import scratch_dir


def hot_rows(spark, n=600):
    """One key holds two thirds of the rows."""
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", rnd.randint(0, 5000), i, rnd.choice("abc")) for i in range(n)]
    return rows, literal_table(spark, rows, "k string, t bigint, seq bigint, v string")


def test_previous_and_next_row(spark):
    rows, df = hot_rows(spark)
    got = {r["seq"]: (r["p"]["v"] if r["p"] else None, r["n"]) for r in skew.with_next(
        skew.with_previous(df, ["k"], ["t", "seq"], ["v"], F.floor(F.col("t") / 500), "p"), ["k"], ["t", "seq"], "v", F.floor(F.col("t") / 500), "n").collect()}
    for key in {r[0] for r in rows}:
        seq = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(seq):
            assert got[r[2]] == (seq[i - 1][3] if i else None, seq[i + 1][3] if i + 1 < len(seq) else None)


def test_row_number(spark):
    rows, df = hot_rows(spark)
    got = {r["seq"]: r["rank"] for r in skew.with_row_number(df, ["k"], [F.desc("t"), F.asc("seq")], [(F.floor(F.col("t") / 700), False)]).collect()}
    for key in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            assert got[r[2]] == i


def test_first_and_last_per_key(spark):
    rows, df = hot_rows(spark)
    first = {r["k"]: r["seq"] for r in skew.first_per_key(df, ["k"], [F.col("t"), F.col("seq")]).collect()}
    last = {r["k"]: r["seq"] for r in skew.last_per_key(df, ["k"], [F.col("t"), F.col("seq")]).collect()}
    for key in first:
        seq = sorted((r[1], r[2]) for r in rows if r[0] == key)
        assert first[key] == seq[0][1] and last[key] == seq[-1][1]


def test_lookup_join_beyond_the_broadcast_bound(spark, monkeypatch):
    _, df = hot_rows(spark)
    ref = literal_table(spark, [("hot", 1), ("k0", 2)], "k string, x int")
    want = sorted(map(tuple, skew.lookup_join(df, ref, ["k"], "left").select("seq", "x").collect()), key=str)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, skew.lookup_join(df, ref, ["k"], "left").select("seq", "x").collect()), key=str) == want


@pytest.mark.parametrize("version", [4, 6])
def test_as_of_lookup_matches_brute_force(spark, version):
    rnd = random.Random(version)
    width = 32 if version == 4 else 128
    top, scale = 1 << width, 1 << (width - 12)
    base = rnd.getrandbits(width - 3)
    spots = lambda: (base + rnd.randint(0, 400) * scale // 37) % top
    ranges = []
    for i in range(60):
        s = spots()
        ranges.append((s, min(top - 1, s + rnd.choice([0, 1, 255, scale // 50, scale, scale * 9])), 64500 + i))
    ips = sorted({spots() + rnd.choice([0, 0, 1, 255, 256]) for _ in range(300)} | {s for s, _, _ in ranges} | {min(e + 1, top - 1) for _, e, _ in ranges})
    bits = lambda x: f"{x:0{width}b}"
    table = literal_table(spark, [(version, bits(s), bits(e), a, "US", "o") for s, e, a in ranges], "ip_version int, start_bits string, end_bits string, asn bigint, country string, organization string")
    got = {int(r["ip_bits"], 2): r["asn"] for r in enrich.lookup_asn(literal_table(spark, [(bits(i),) for i in ips], "ip_bits string"), table).collect()}
    for ip in ips:
        below = [r for r in ranges if r[0] <= ip]
        hit = None
        if below:
            start = max(r[0] for r in below)
            best = max((r for r in below if r[0] == start), key=lambda r: (r[1], -r[2]))
            hit = best[2] if ip <= best[1] else None
        assert got.get(ip) == hit


def test_longest_prefix(spark):
    nets = [("cup", "198.18.0.0/15"), ("pot", "198.18.64.0/18"), ("lid", "2001:db8:40::/42"), ("tin", "198.18.64.0/18")]
    ranges = normalize_cidrs(literal_table(spark, nets, "provider string, cidr string"), "cidr", "n").select(
        "provider", F.lit("o").alias("organization"), F.lit("c").alias("category"), "cidr", F.col("n.version").alias("ip_version"), F.col("n.bits").alias("net_bits"))
    want = {"198.19.255.255": "cup", "198.18.127.1": "pot", "198.18.128.0": "cup", "2001:db8:7f::": "lid", "2001:db8:80::": None, "198.20.0.0": None, "tea": None}
    ips = with_ip_bits(literal_table(spark, [(i,) for i in want], "ip string"), F.col("ip"), "ip_bits")
    hits = enrich.attribute_cloud(ips, ranges)
    assert {r["ip"]: r["provider"] for r in ips.join(hits, "ip_bits", "left").collect()} == want


@pytest.mark.parametrize("looks", [12, 0])
def test_longest_prefix_needs_no_grouping_of_hits(spark, monkeypatch, looks):
    """Blocks of several lengths and both versions, /0 and whole addresses among them; with few lengths no hit is exploded or grouped."""
    monkeypatch.setattr(enrich, "LOOKS", looks)
    rnd = random.Random(7)
    cut = [(4, "")] + sorted({(v, "".join(rnd.choice("01") for _ in range(n))) for v, lengths in ((4, (1, 3, 32)), (6, (3, 33, 128))) for n in lengths for _ in range(3)})
    blocks = literal_table(spark, [(v, b, f"p{i}") for i, (v, b) in enumerate(cut)], "ip_version int, net_bits string, provider string")
    addresses = {b.ljust(32 if v == 4 else 128, c) for v, b in cut for c in "01"} | {"".join(rnd.choice("01") for _ in range(w)) for w in (32, 128) for _ in range(20)}
    ips = literal_table(spark, [(a,) for a in sorted(addresses)] * 2 + [(None,)], "ip_bits string")
    out = enrich.longest_prefix(ips, blocks, ["provider"])
    want = {}
    for a in addresses:
        fit = [(len(b), f"p{i}") for i, (v, b) in enumerate(cut) if (v == 4) == (len(a) == 32) and a.startswith(b)]
        if fit:
            want[a] = max(fit)
    assert {r["ip_bits"]: (r["prefix_len"], r["provider"]) for r in out.collect()} == want and out.count() == len(want)
    assert ("explode" in out._jdf.queryExecution().optimizedPlan().toString()) == (looks == 0)


def test_expansion_skips_edges(spark):
    nets = normalize_cidrs(literal_table(spark, [("10.0.0.0/30",), ("10.0.1.7/32",), ("10.0.2.0/31",), ("10.0.0.0/8",)], "c string"), "c", "n").select(
        "c", F.col("n.version").alias("ip_version"), F.col("n.bits").alias("net_bits"))
    got = {}
    for r in enrich.expand_cidrs(nets, 256).collect():
        got.setdefault(r["c"], []).append(str(ipaddress.ip_address(int(r["ip_bits"], 2))))
    assert {k: sorted(v) for k, v in got.items()} == {"10.0.0.0/30": ["10.0.0.1", "10.0.0.2"], "10.0.1.7/32": ["10.0.1.7"], "10.0.2.0/31": ["10.0.2.0", "10.0.2.1"]}


def test_expansion_looks_up_networks_not_addresses(spark):
    """Rules, blocks and range ends inside small networks, v6 and mapped ones included, against every address on its own."""
    from palisade.operators import scope
    from palisade.plans import discovery

    def bits(texts, column):
        return normalize_cidrs(literal_table(spark, texts, column), "c", "n").withColumn("ip_version", F.col("n.version")).withColumn("net_bits", F.col("n.bits")).drop("n")

    nets = ["10.0.0.0/24", "10.0.1.0/24", "10.0.2.0/28", "10.0.3.0/24", "10.0.4.9/32", "10.0.5.0/31", "10.1.0.0/24", "10.2.0.0/24", "10.0.0.0/16", "2001:db8::/120", "2001:db8::100/120"]
    cidrs = bits([(p, c) for c in nets for p in ("P1", "P2")], "program_id string, c string").select(
        "program_id", F.col("c").alias("cidr"), "ip_version", "net_bits", F.lit("2024-01-31").cast("timestamp").alias("observed_at"), F.lit(1).cast("long").alias("seq"))
    mapped = cidrs.filter("cidr = '10.2.0.0/24'").withColumn("cidr", F.lit("mapped")).withColumn("ip_version", F.lit(6)).withColumn("net_bits", F.concat(F.lit("0" * 80 + "1" * 16), "net_bits"))
    cidrs = cidrs.unionByName(mapped)
    rules = scope.scope_rules(literal_table(spark, [
        ("a", "P1", "cidr", "include", "10.0.0.0/8"), ("b", "P1", "cidr", "exclude", "10.0.0.64/26"), ("c", "P1", "ipv4", "exclude", "10.0.1.7"), ("d", "P2", "cidr", "include", "10.0.1.0/25"),
        ("e", "P2", "url", "exclude", "https://10.0.1.9/"), ("f", "P1", "cidr", "include", "2001:db8::/121"), ("g", "P1", "ipv4", "exclude", "10.2.0.8")],
        "rule_id string, program_id string, type string, mode string, value string"))
    clouds = bits([("x", "10.0.0.0/12"), ("y", "10.0.2.8/30")], "provider string, c string").select("provider", F.lit("o").alias("organization"), F.lit("k").alias("category"), F.col("c").alias("cidr"), "ip_version", "net_bits")
    at = lambda a: f"{int(ipaddress.ip_address(a)):032b}"
    ranges = literal_table(spark, [(4, at("10.0.0.0"), at("10.0.3.99"), 1, "US", "o"), (4, at("10.0.3.200"), at("10.0.255.255"), 2, "DE", "p")],
                           "ip_version int, start_bits string, end_bits string, asn long, country string, organization string")
    looked = []
    plan = discovery.expansion_plan(cidrs, rules, clouds, ranges, 256, stage=lambda df: looked.append(df) or df)

    ips = enrich.expand_cidrs(cidrs, 256).withColumn("ip", discovery.ip_text(F.col("ip_bits")))
    want = enrich.enrich_ips(scope.with_decision(ips, rules, "ip", "program_id"), clouds, ranges, "ip_bits").select(*plan.rows.columns)
    assert sorted(map(str, plan.rows.collect())) == sorted(map(str, want.collect()))
    assert {r["cidr"] for r in plan.extra["oversized"].collect()} == {"10.0.0.0/16"}
    # 10.0.4.9/32, 10.0.5.0/31, 10.1.0.0/24 and 2001:db8::100/120 hold nothing
    per_network = {r["cidr"]: r["n"] for r in looked[0].groupBy("cidr").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {c for c, n in per_network.items() if n == 2} == {"10.0.4.9/32", "10.0.5.0/31", "10.1.0.0/24", "2001:db8::100/120"}


def test_networks_are_cut_where_answers_change(spark, monkeypatch):
    """Random networks, rules, blocks and ranges, crowded buckets among them, against every address on its own; a divided network is cut, not listed."""
    from palisade.operators import scope
    from palisade.plans import discovery

    rnd = random.Random(5)
    monkeypatch.setattr(enrich, "HOT_NETWORKS", 9)
    base = {4: ipaddress.ip_address("10.0.0.0"), 6: ipaddress.ip_address("2001:db8::")}

    def net(version, lengths):
        width, n = 32 if version == 4 else 128, rnd.choice(lengths)
        at = int(base[version]) + rnd.randrange(1 << 12)
        return f"{ipaddress.ip_address(at >> (width - n) << (width - n))}/{n}", version, f"{at:0{width}b}"[:n]

    tails = {4: [24, 26, 28, 30, 31, 32], 6: [120, 122, 125, 128]}
    rows = [(p, *net(v, tails[v]), 1) for v in (4, 6) for p in ("P1", "P2") for _ in range(14)] + [("P1", *net(4, [12, 20]), 1), (None, *net(4, [24]), 1)]
    cidrs = literal_table(spark, rows + rows[:3], "program_id string, cidr string, ip_version int, net_bits string, seq long").withColumn("observed_at", F.lit("2024-01-31").cast("timestamp"))
    rules = scope.scope_rules(literal_table(spark, [(f"r{i}", rnd.choice(["P1", "P2", "P3"]), "cidr", rnd.choice(["include", "exclude"]), net(v, [w - 12, w - 9, w - 5, w])[0])
                                                    for i, (v, w) in enumerate([(4, 32), (6, 128)] * 8)], "rule_id string, program_id string, type string, mode string, value string"))
    clouds = literal_table(spark, [(f"c{i}", "o", "k", *net(v, [w - 11, w - 6, w - 2])) for i, (v, w) in enumerate([(4, 32), (6, 128)] * 5)],
                           "provider string, organization string, category string, cidr string, ip_version int, net_bits string")
    ends = [(v, w, sorted(int(base[v]) + rnd.randrange(1 << 12) for _ in "ab")) for v, w in [(4, 32), (6, 128)] * 5]
    ranges = literal_table(spark, [(v, f"{a:0{w}b}", f"{b:0{w}b}", i, "US", "o") for i, (v, w, (a, b)) in enumerate(ends)],
                           "ip_version int, start_bits string, end_bits string, asn long, country string, organization string")
    looked = []
    plan = discovery.expansion_plan(cidrs, rules, clouds, ranges, 256, stage=lambda df: looked.append(df) or df)
    ips = enrich.expand_cidrs(cidrs, 256).withColumn("ip", discovery.ip_text(F.col("ip_bits")))
    want = enrich.enrich_ips(scope.with_decision(ips, rules, "ip", "program_id"), clouds, ranges, "ip_bits").select(*plan.rows.columns)
    got = plan.rows.collect()
    assert sorted(map(str, got)) == sorted(map(str, want.collect()))
    assert looked[0].count() * 4 < len(got)  # before, a network with one end inside was listed whole
    assert looked[0]._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_merging_twice_changes_nothing(spark):
    obs = literal_table(spark, [("a", "b", "R", "x", 0.5, "m1", 10, 1), ("a", "b", "R", "y", 0.9, "m2", 20, 2)], "source_id string, target_id string, relationship_type string, source string, confidence double, metadata string, seen_at bigint, seq bigint")
    empty = spark.createDataFrame([], "source_id string, target_id string, relationship_type string, source string, confidence double, metadata string, first_seen bigint, last_seen bigint")
    once = merge.upsert_edges(empty, obs)
    row = once.first()
    assert (row["metadata"], row["first_seen"], row["last_seen"], row["inserted"]) == ("m1", 10, 20, True)
    twice = merge.upsert_edges(once.drop("inserted"), obs).first()
    assert (twice["metadata"], twice["last_seen"], twice["inserted"]) == ("m1", 20, False)


def test_equal_states_have_no_changes(spark):
    df = spark.range(3).select("id", F.struct(F.array(F.lit("1.1.1.1"), F.lit("2.2.2.2")).alias("a"), *[F.array().cast("array<string>").alias(c) for c in ("aaaa", "cname", "mx", "ns", "txt", "asn", "cloud")], F.lit(True).alias("has_asn"), F.lit(True).alias("has_cloud")).alias("current"))
    same = df.withColumn("previous", F.col("current").withField("a", F.array(F.lit("2.2.2.2"), F.lit("1.1.1.1"))))
    assert changes.diff_dns(same, ["id"]).count() == 0


def test_change_order_puts_the_summary_first(spark):
    schema = "id int, previous struct<fingerprint:string,issuer:string,san:array<string>,tls_version:string,not_after:string,expiry_status:string>, current struct<fingerprint:string,issuer:string,san:array<string>,tls_version:string,not_after:string,expiry_status:string>"
    rows = [(1, ("A", "X", ["a"], "tls12", None, None), ("A", "Y", ["a", "b"], "tls13", None, None)), (2, None, ("A", None, None, None, "2026-10-20", "expiring"))]
    got = changes.diff_tls(spark.createDataFrame(rows, schema), ["id"]).orderBy("id", "ord").collect()
    assert [r["change_type"] for r in got if r["id"] == 1] == ["TLS_CHANGED", "ISSUER_CHANGED", "SAN_CHANGED", "TLS_VERSION_CHANGED"]
    assert [r["change_type"] for r in got if r["id"] == 2] == ["CERT_EXPIRING"]


def test_nested_terms_count_documents_of_each_level(spark):
    rows = [("a", ["x", "y"]), ("a", ["x"]), ("b", ["x"]), ("b", None), ("b", None), ("c", ["z"])]
    df = spark.createDataFrame(rows, "p string, tags array<string>")
    got = [tuple(r) for r in ranking.terms_table(df, ["p", "tags"], 2).orderBy("k1", "k2").collect()]
    assert got == [("a", "x", 2), ("a", "y", 1), ("b", "x", 1)]
    assert [tuple(r) for r in ranking.terms(df, "tags", 2).collect()] == [("x", 3), ("y", 1)]


def test_approximate_distinct_is_close(spark):
    df = spark.range(50_000).select((F.col("id") % 20_000).alias("x"))
    exact, rough = ranking.distinct_count(df, "x").first()[0], ranking.distinct_count(df, "x", exact=False).first()[0]
    assert exact == 20_000 and abs(rough - exact) < 0.15 * exact


def test_fair_share_matches_the_dispatch_loop(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 2), rnd.choice("ab"), rnd.choice(["PENDING", "PENDING", "QUEUED"]), rnd.randint(0, 9), i) for i in range(200)]
    df = literal_table(spark, rows, "job_id bigint, program_id bigint, scanner string, status string, priority int, created_at bigint")
    got = {r["job_id"] for r in ranking.fair_share_admit(df, 20).collect()}
    queued, want = {}, set()
    for r in rows:
        if r[3] == "QUEUED":
            queued[r[1:3]] = queued.get(r[1:3], 0) + 1
    for r in sorted((r for r in rows if r[3] == "PENDING"), key=lambda r: (-r[4], r[5])):
        if r[4] >= 7 or queued.get(r[1:3], 0) < 20:
            want.add(r[0])
            queued[r[1:3]] = queued.get(r[1:3], 0) + 1
    assert got == want


def test_kev_sync_baseline_and_empty_feed(spark):
    cur = sync.with_content_hash(literal_table(spark, [("CVE-1", "v", "p")], "cve_id string, vendor string, product string"))
    old = spark.createDataFrame([], "cve_id string, content_hash string, removed_at timestamp")
    assert sync.sync_kev(old, cur).first()["event_type"] == "KEV_BASELINE"
    with pytest.raises(sync.EmptyFeed):
        sync.sync_kev(old, cur.limit(0))


def test_replace_table_refuses_truncated_content(spark):
    path = scratch_dir(spark, "replace")
    good = spark.range(1000).select("id", F.lit(1).alias("x"))
    events.replace_table(good, path, ["id"], [F.col("x")])
    with pytest.raises(events.TruncatedLoad):
        events.replace_table(good.limit(5), path, ["id"], [F.col("x")])
    assert events.read_snapshot(spark, path).count() == 1000


def test_certificate_messages(spark):
    import json

    def update(**leaf):
        return json.dumps({"message_type": "certificate_update", "data": {"leaf_cert": leaf}})

    msgs = [
        json.dumps({"message_type": "stats"}), update(), "not json",
        update(subject={"CN": "Pear.Orchard.test."}, extensions={"subjectAltName": "DNS:plum.orchard.test, DNS:*.jam.orchard.test, IP:203.0.113.5, DNS:-x.test"}, fingerprint="0A:0B", all_domains=["fig.orchard.test"]),
        update(sha256="C0:FF:EE", all_domains=["*.orchard.test", "orchard.test", "orchard.test"]),
    ]
    got = {r["fingerprint"]: r for r in certificates.parse_ct(literal_table(spark, [(m,) for m in msgs], "value string")).collect()}
    assert set(got) == {"sha1:0a0b", "c0ffee"}
    assert set(got["sha1:0a0b"]["domains"]) >= {"plum.orchard.test", "fig.orchard.test"} and got["sha1:0a0b"]["wildcards"] == ["*.jam.orchard.test"]
    assert "-x.test" in got["sha1:0a0b"]["invalid_names"]
    assert (got["c0ffee"]["domains"], got["c0ffee"]["wildcards"]) == (["orchard.test"], ["*.orchard.test"])


def test_feeds(spark):
    def table(*lines):
        return literal_table(spark, [(x,) for x in lines], "value string")

    scores, meta = records.parse_epss(table("#model_version:t3,score_date:2031-05-06T00:00:00Z", "cve,epss,percentile", "CVE-2031-7,0.25,1", "CVE-2031-8,0.5,1.5", "GHSA-1,0.1,0.1", "CVE-2031-9,-1,0", "x"))
    assert [tuple(r) for r in scores.collect()] == [("CVE-2031-7", 0.25, 1.0)]
    assert (meta.first()["model_version"], str(meta.first()["score_date"])) == ("t3", "2031-05-06")
    owner = "Tea & Biscuits" * 40
    got = records.parse_asn_tsv(table(f"203.0.113.0\t203.0.113.63\t65010\tNone\t{owner}", "2001:db8::\t2001:db8::ff\t65011\tNZ\tx", "203.0.113.64\t203.0.113.70\t0\tNZ\tnobody", "203.0.113.9\t203.0.113.1\t1\tNZ\tturned", "203.0.113.9")).collect()
    assert [(r["asn"], r["country"]) for r in got] == [(65010, None), (65011, "NZ")] and got[0]["organization"] == owner
    nets, bad = records.parse_cidr_list(table("203.0.113.77/28", "# note", "", "2001:db8:5::/48", "203.0.113.0/99"))
    assert {r["cidr"] for r in nets.collect()} == {"203.0.113.64/28", "2001:db8:5::/48"} and [r[0] for r in bad.collect()][-1:] and bad.count() == 1
    kev = [(2, '{"vulnerabilities":[{"cveID":"CVE-1","product":"new"}]}'), (1, '{"vulnerabilities":[{"cveID":"cve-1","product":"old"},{"cveID":"CVE-2","product":"first"},{"cveID":"CVE-2","product":"last"},{"cveID":"x"}]}')]
    found = records.parse_kev(literal_table(spark, kev, "day int, value string"), order="day")
    assert {r["cve_id"]: r["product"] for r in found.collect()} == {"CVE-1": "new", "CVE-2": "last"}


def test_runs_without_findings_resolve_everything(spark):
    from palisade.operators import changes

    found = spark.createDataFrame([("h", 1, "f1", "low", "t", "u"), ("h", 3, "f1", "low", "t", "u")], "host string, run int, finding_hash string, severity string, template_id string, url string")
    runs = spark.createDataFrame([("h", 1), ("h", 2), ("h", 3)], "host string, run int")
    assert sorted((r["run"], r["change_type"]) for r in changes.diff_findings(found, runs=runs).collect()) == [(2, "FINDING_RESOLVED"), (3, "NEW_FINDING")]
    assert changes.diff_findings(found).count() == 0


def test_scratch_folder_needs_a_shared_place_on_a_cluster():
    from types import SimpleNamespace

    from palisade.session import scratch_dir

    def session(master, folder=None):
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master, getConf=dict))

    assert scratch_dir(session("yarn", "hdfs://shared/tmp"), "x").startswith("hdfs://shared/tmp/palisade/x-")
    assert scratch_dir(session("local[2]"), "x")
    with pytest.raises(ValueError):
        scratch_dir(session("local-cluster[2,1,1024]"), "x")


def test_stale_lookups_are_ignored(spark):
    obs = literal_table(spark, [(1, "c1"), (2, "c2")], "asset_id bigint, cpe string")
    lookups = spark.sql("SELECT * FROM VALUES ('c1', array('CVE-1'), timestamp'2024-01-30'), ('c2', array('CVE-2'), timestamp'2024-01-01') AS t(cpe, cve_ids, fetched_at)")
    got = vuln.cves_for_cpe(obs, lookups, F.lit("2024-01-31").cast("timestamp")).collect()
    assert [(r["asset_id"], r["cve_id"]) for r in got] == [(1, "CVE-1")]


def test_plans_have_no_nested_loops(spark, sf):
    from palisade import catalogue

    for name in ("jn11_longest_prefix", "jn12_as_of_range", "jn19_policy_match", "job2_guards"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_panels_by_sketches_come_close(spark):
    """The same dashboard with sketches: everything but the distinct values is equal, those lie within 5 %."""
    from palisade.catalogue import panelling
    from palisade.catalogue.standins import NOW
    from palisade.plans import panels

    now = F.lit(NOW).cast("timestamp")
    indices = {i: panelling.index_table(spark, "/root/testdata/sf0.01", i) for i in dict.fromkeys(p.index for p in panels.RECON)}
    exact, near = ({(r.panel, r.k1, r.k2, r.k3): r.value for r in panels.run_dashboard(indices, "recon", now, exact=e).collect()} for e in (True, False))
    assert set(exact) == set(near)
    unique = {p.id for p in panels.RECON if p.kind == "unique"}
    assert all(abs(near[k] - v) <= 0.05 * v if k[0] in unique else near[k] == v for k, v in exact.items())
    assert sum(v > 0 for k, v in exact.items() if k[0] in unique) >= 3


def test_a_panel_dashboard_scans_an_index_once(spark):
    from palisade.catalogue import panelling
    from palisade.catalogue.standins import NOW
    from palisade.plans import panels

    http = panelling.index_table(spark, "/root/testdata/sf0.001", "bb-http")
    plans = []
    out = panels.run_dashboard({"bb-http": http}, "web", F.lit(NOW).cast("timestamp"), stage=lambda df: plans.append(df) or df)
    assert out.count() > 0
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_written_events_are_cut_by_the_size_of_their_input(spark, monkeypatch, tmp_path):
    """One index and month with nearly all rows is written by many tasks, each with its own range of time; nothing is lost."""
    spark.range(20_000).selectExpr(
        "timestamp_seconds(1704067200 + id) AS ts", "IF(id % 100 = 0, 'bb-jobs', 'bb-http') AS index", "IF(id % 1000 = 0, NULL, '2024.01') AS ym", "concat('payload ', id) AS payload",
    ).coalesce(1).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    monkeypatch.setattr(skew, "TASK_BYTES", 10_000)
    events.write_events(raw, f"{tmp_path}/events")
    back = events.read_events(spark, f"{tmp_path}/events")
    rows = lambda df: sorted(map(str, df.select("ts", "index", F.col("ym").cast("string"), "payload").collect()))
    assert rows(back) == rows(raw)
    tasks = skew.tasks_by_input(raw, share=2)
    files = back.filter("index = 'bb-http' AND ym IS NOT NULL").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect()
    assert tasks > 8 and len(files) > tasks // 2 and max(f["n"] for f in files) < 4 * 20_000 / tasks
    assert all(x["b"] < y["a"] for x, y in zip(files, files[1:]))


def test_dns_outputs_parse_only_what_they_need(spark):
    """States and AS edges need no names, edges no providers; written and unwritten plans give the same."""
    from palisade.plans import base, dns

    made = [("h1.example.com", "A", "192.0.2.7"), ("h1.example.com", "A", "192.0.2.200"), ("h1.example.com", "AAAA", "2001:db8::1"), ("h1.example.com", "A", "not one"),
            ("h2.example.com", "CNAME", "Target.Example.NET."), ("h2.example.com", "NS", "bad..name"), ("h2.example.com", "TXT", "192.0.2.7"), ("h3.example.com", "A", None)]
    answers = literal_table(spark, [(n, t, v, i) for i, (n, t, v) in enumerate(made)], "name string, record_type string, value string, seq bigint").selectExpr(
        "name", "1 AS run", "TIMESTAMP '2024-01-01' AS observed_at", "seq", "record_type", "value", "value IS NULL AS nxdomain")
    bits = lambda x: f"{int(ipaddress.ip_address(x)):032b}"
    clouds = literal_table(spark, [(4, bits("192.0.2.0")[:24], "amazon", "Amazon", "cloud", "192.0.2.0/24")], "ip_version int, net_bits string, provider string, organization string, category string, cidr string")
    ranges = literal_table(spark, [(4, bits("192.0.2.0"), bits("192.0.2.99"), 64501, "US", "org")], "ip_version int, start_bits string, end_bits string, asn bigint, country string, organization string")
    plan, written = (dns.dns_plan(answers, clouds, ranges, stage) for stage in (base.as_is, base.staged("dns-test")))
    text = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for one, other in ((plan.states, written.states), (plan.edges, written.edges), (plan.assets, written.assets), (plan.extra["addresses"], written.extra["addresses"])):
        assert text(one) == text(other)
    edges = {(r["source_id"], r["target_id"]) for r in plan.edges.collect()}
    assert ("192.0.2.7", "AS64501") in edges and ("192.0.2.200", "AS64501") not in edges and ("h2.example.com", "target.example.net") in edges
    states = {r["asset_id"]: r for r in plan.states.collect()}
    assert states["h1.example.com"]["current"]["asn"] == ["64501"] and states["h1.example.com"]["current"]["cloud"] == ["amazon"] and states["h3.example.com"]["status"] == "NXDOMAIN"
    shown = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "__o_target" not in shown(plan.states) and "provider" not in shown(plan.edges.select("source_id", "target_id"))
