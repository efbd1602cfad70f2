"""Scope decisions: expected values, agreement with a brute-force oracle, plan shape."""

from __future__ import annotations

import ipaddress
import random

import pytest

from palisade.functions.common import literal_table
from palisade.operators import scope

SHAPE = "rule_id string, program_id string, type string, mode string, value string"


def made(seed: int, rounds: int = 14):
    """Rules of every kind for two programs, and targets on either side of each rule's edge: (rules, {target: what it is}).

    A target is (kind, value): name, net, asn, url as (scheme, host, port, segments), or bad for what cannot be read."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    rules, targets = [], {}

    def rule(kind, value, mode=None):
        mode = mode or rnd.choice(["include", "include", "exclude"])
        rules.append((f"{rnd.randrange(10**6):06}-{len(rules)}", rnd.choice(["left", "right"]), kind, mode, value))

    def name(n):
        targets[n] = ("name", n)

    def net(text):
        targets[text] = ("net", ipaddress.ip_network(text))

    def url(scheme, host, port, path, shown=None):
        default = {"http": 80, "https": 443}[scheme]
        text = f"{scheme}://{host}" + (f":{port}" if port != default else "") + (shown or path)
        targets[text] = ("url", (scheme, host, port, [x for x in path.split("/") if x]))

    for _ in range(rounds):
        zone = f"{word()}.{word()}.example"
        deep = f"{word()}.{zone}"
        rule("wildcard", f"*.{zone}", "include")
        rule(rnd.choice(["domain", "wildcard"]), rnd.choice([deep, zone]) if rnd.random() < 0.7 else word() + "." + zone)
        if rules[-1][2] == "wildcard":
            rules[-1] = (*rules[-1][:4], "*." + rules[-1][4])
        for n in (zone, deep, f"{word()}.{deep}", f"{word()}.{word()}.{deep}", f"{word()}{zone}", f"{zone}.{word()}.example", f"{word()}.{zone}"):
            name(n)
        bits = rnd.randint(18, 30)
        base = ipaddress.ip_network((rnd.getrandbits(32) >> (32 - bits) << (32 - bits), bits))
        rule("cidr", str(base))
        rule(*(("ipv4", str(base[1])) if rnd.random() < 0.5 else ("cidr", str(next(base.subnets(2))))))
        for n in (base, base.supernet(), next(base.subnets()), ipaddress.ip_network(base[0]), ipaddress.ip_network(base[1]), ipaddress.ip_network(base[-1])):
            net(str(n))
        over = int(base[-1]) + 1
        if over < 2**32:
            net(str(ipaddress.ip_network(over)))
        number = rnd.randint(64512, 65534)
        rule("asn", str(number))
        for x in (number, number + 1):
            targets[f"AS{x}"] = ("asn", x)
        scheme, port = rnd.choice(["http", "https"]), rnd.choice([80, 443, 8080])
        host, path = rnd.choice([deep, zone, f"{word()}.{word()}.example"]), rnd.choice(["", f"/{word()}", f"/{word()}/{word()}"])
        standard = port == {"http": 80, "https": 443}[scheme]
        rule("url", f"{scheme}://{host}" + ("" if standard else f":{port}") + path)
        for sc, po, pa in ((scheme, port, path), (scheme, port, f"{path}/{word()}"), (scheme, port, f"{path}{word()}" if path else "/"), (scheme, port + 1, path), ("https" if scheme == "http" else "http", port, path), (scheme, port, "/" + word())):
            url(sc, host, po, pa)
        url(scheme, host, port, path, shown=f"/{word()}/..{path or '/'}?{word()}=1")
        name(host)
    for text in ("", "198.51.100", "0xC6.51.100.33", "name with space.example", f"{word()}.example:80", "gopher://a.b.example/", "https://a.example@b.example/", f"-{word()}.example", "fe80::1%eth0"):
        targets[text] = ("bad", None)
    return rules, targets


def decided(target, rules):
    """(allowed, excluded) by looking at every rule."""
    kind, v = target

    def host_hit(r, host):
        base = r[4].removeprefix("*.")
        below = host.endswith("." + base)
        return below if r[2] == "wildcard" else host == base or (below and r[3] == "exclude")

    def hit(r):
        if r[2] in ("domain", "wildcard"):
            return kind in ("name", "url") and host_hit(r, v if kind == "name" else v[1])
        if r[2] in ("cidr", "ipv4"):
            own = ipaddress.ip_network(r[4])
            return kind == "net" and own.version == v.version and (v.subnet_of(own) if r[3] == "include" else v.overlaps(own))
        if r[2] == "asn":
            return kind == "asn" and int(r[4]) == v
        scheme, rest = r[4].split("://")
        place, *segments = rest.split("/")
        host, _, port = place.partition(":")
        at = (scheme, host, int(port or {"http": 80, "https": 443}[scheme]))
        if kind == "name":  # a whole origin that is excluded takes its host with it
            return r[3] == "exclude" and not segments and host == v
        return kind == "url" and v[:3] == at and v[3][: len(segments)] == segments

    out = any(r[3] == "exclude" and hit(r) for r in rules)
    return not out and any(r[3] == "include" and hit(r) for r in rules), out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decisions_agree_with_brute_force(spark, seed):
    made_rules, targets = made(seed)
    rows = [(t, p) for t in targets for p in ("left", "right")]
    got = scope.evaluate_scope(literal_table(spark, rows, "target string, program_id string"), rule_table(spark, made_rules)).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in made_rules}
    for r in got:
        allowed, out = decided(targets[r["target"]], [x for x in made_rules if x[1] == r["program_id"]])
        assert r["allowed"] == allowed and (r["match_kind"] == "explicit_exclusion") == out, (r, targets[r["target"]])
        if r["scope_id"] is not None:
            rule = by_id[r["scope_id"]]
            assert rule[1] == r["program_id"] and decided(targets[r["target"]], [rule]) == (allowed, out)
        elif targets[r["target"]][0] != "bad":
            assert r["match_kind"] == "none" and r["reason"] == "not in approved scope"


# one program for the tests of single functions
RULES = [
    ("w", "tea", "wildcard", "include", "*.kettle.example"), ("d", "tea", "domain", "exclude", "attic.kettle.example"), ("e", "tea", "wildcard", "exclude", "*.cellar.kettle.example"),
    ("n", "tea", "cidr", "include", "198.51.100.32/27"), ("o", "tea", "ipv4", "exclude", "198.51.100.40"), ("u", "tea", "url", "exclude", "https://shop.kettle.example/drafts"),
    ("p", "milk", "wildcard", "include", "*.kettle.example"),
]


def rule_table(spark, rules):
    return scope.scope_rules(literal_table(spark, rules, SHAPE))


@pytest.fixture(scope="module")
def rules(spark):
    return rule_table(spark, RULES)


def test_spellings_of_one_target(spark, rules):
    """Case, a final dot, international names, mapped addresses and encoded paths do not change a decision."""
    pairs = {"Green.KETTLE.example.": True, "grün.kettle.example": True, "ATTIC.kettle.example": False, "::ffff:198.51.100.33": True, "https://shop.kettle.example/x/%2e%2e/drafts": False,
             "https://shop.kettle.example/x/../draft": True, "green.kettle.example\t.other.example": False, "https://other.example\\.kettle.example/": False, "3325256737": False}
    got = {r["target"]: r["allowed"] for r in scope.evaluate_scope(literal_table(spark, [(t, "tea") for t in pairs], "target string, program_id string"), rules).collect()}
    assert got == pairs


def test_programs_do_not_mix(spark, rules):
    rows = [("attic.kettle.example", "milk"), ("green.kettle.example", "unknown"), ("198.51.100.33", "milk")]
    got = {}
    for r in scope.evaluate_scope(literal_table(spark, rows, "target string, program_id string"), rules).collect():
        got[r["target"], r["program_id"]] = r["allowed"]
    assert got == {rows[0]: True, rows[1]: False, rows[2]: False}


def test_overall(spark, rules):
    names = ["green.kettle.example", "attic.kettle.example", "elsewhere.example", "*.kettle.example"]
    got = {r["target"]: r for r in scope.scope_overall(literal_table(spark, [(n,) for n in names], "target string"), rules).collect()}
    assert [got[n]["allowed_programs"] for n in names[:2]] == [["milk", "tea"], ["milk"]]
    assert got[names[0]]["program_id"] == "milk"
    assert not got[names[2]]["allowed"] and got[names[2]]["reason"] == "not in approved scope"
    assert not got[names[3]]["allowed"] and got[names[3]]["reason"].startswith("wildcard patterns")


def test_wildcards_over_unknown_suffixes_are_refused(spark):
    """Without a full list, what may be a public suffix is taken for one."""
    rows = ["*.com.sg", "*.ac.uk", "*.gov.qq", "*.bank.com.sg", "*.bank.qq", "*.example.uk", "*.co.uk", "*.kettle.example"]
    got = {r["rule_id"]: r["error"] for r in scope.scope_rules(literal_table(spark, [(v, "p", "wildcard", "include", v) for v in rows], SHAPE)).collect()}
    assert {v for v in rows if got[v]} == {"*.com.sg", "*.ac.uk", "*.gov.qq", "*.bank.qq", "*.co.uk"}
    given = {r["rule_id"]: r["error"] for r in scope.scope_rules(literal_table(spark, [(v, "p", "wildcard", "include", v) for v in rows], SHAPE), suffixes=["qq", "uk", "co.uk", "ac.uk", "sg", "com.sg", "example"]).collect()}
    assert {v for v in rows if given[v]} == {"*.com.sg", "*.ac.uk", "*.gov.qq", "*.co.uk"}  # a list cannot clear a name that stands for a kind of registrant


def test_wildcards_over_given_suffixes_are_refused(spark):
    rules = literal_table(spark, [("r1", "p", "wildcard", "include", "*.shops.test"), ("r2", "p", "wildcard", "include", "*.tea.shops.test")], "rule_id string, program_id string, type string, mode string, value string")
    errors = {r["rule_id"]: r["error"] for r in scope.scope_rules(rules, suffixes=["test", "shops.test"]).collect()}
    assert errors == {"r1": "public_suffix", "r2": None}


def test_empty_rules_deny(spark):
    got = scope.evaluate_scope(literal_table(spark, [("example.com", "P1")], "target string, program_id string"), rule_table(spark, []))
    assert [r["allowed"] for r in got.collect()] == [False]


def test_v6_overlap(spark):
    rules = rule_table(spark, [("a", "P", "cidr", "include", "2001:db8::/32"), ("b", "P", "cidr", "exclude", "2001:db8:dead::/48")])
    rows = [("2001:db8:dead::/64", "P"), ("2001:db8::/40", "P"), ("2001:db8::/31", "P"), ("2001:db8:1::/48", "P"), ("2001:db8:de00::/40", "P")]
    got = {r["target"]: r["match_kind"] for r in scope.evaluate_scope(literal_table(spark, rows, "target string, program_id string"), rules).collect()}
    assert got == {
        rows[0][0]: "explicit_exclusion", rows[1][0]: "explicit_inclusion", rows[2][0]: "explicit_exclusion",
        rows[3][0]: "explicit_inclusion", rows[4][0]: "explicit_exclusion",
    }


def test_networks_agree_with_brute_force(spark):
    rnd = random.Random(3)

    def net(lo):
        n = rnd.randint(lo, 32)
        return ipaddress.ip_network((rnd.getrandbits(12) << 20, 0), strict=False) if n == 0 else ipaddress.ip_network(
            (((0b1010 << 28) | rnd.getrandbits(28)) >> (32 - n) << (32 - n), n)
        )

    rules = [(f"r{i:03}", "P", "cidr", rnd.choice(["include", "include", "exclude"]), str(net(4))) for i in range(60)]
    targets = [str(net(6)) for _ in range(300)]
    got = {r["target"]: r for r in scope.evaluate_scope(literal_table(spark, [(t, "P") for t in targets], "target string, program_id string"), rule_table(spark, rules)).collect()}
    for t in set(targets):
        tn = ipaddress.ip_network(t)
        excl = [r for r in rules if r[3] == "exclude" and ipaddress.ip_network(r[4]).overlaps(tn)]
        incl = [r for r in rules if r[3] == "include" and tn.subnet_of(ipaddress.ip_network(r[4]))]
        want = excl[0][0] if excl else incl[0][0] if incl else None
        assert got[t]["scope_id"] == want and got[t]["allowed"] == (not excl and bool(incl)), t


def test_salted_join_gives_the_same_decisions(spark, monkeypatch):
    from palisade.operators import skew

    made_rules, found = made(4, rounds=6)
    rules, targets = rule_table(spark, made_rules), literal_table(spark, [(t, "left") for t in found], "target string, program_id string")
    broadcast = sorted(map(str, scope.evaluate_scope(targets, rules).collect()))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    assert sorted(map(str, scope.evaluate_scope(targets, rules).collect())) == broadcast


def test_targets_probe_only_keys_in_use(spark):
    """Of a target's names, parents and prefixes only those of a kind and length that some rule has are looked up."""
    from palisade.functions.targets import classify

    rules = rule_table(spark, [("a", "P", "wildcard", "include", "*.o7.example"), ("b", "P", "cidr", "exclude", "10.0.0.0/8"), ("c", "Q", "asn", "include", "AS7")])
    found = ["h1.o7.example", "h1.o8.example", "o7.example", "x.y.o7.example", "10.1.2.3", "11.0.0.0/9", "AS7", "https://h1.o7.example/a", "not a target"]
    classified = classify(literal_table(spark, [(t,) for t in found], "target string"), "target", "__t", idn=True)
    keys = {}
    for r in scope._probes(classified, ("target",), scope.rule_table(rules).uses).collect():
        keys.setdefault(r["target"], []).append(r["key"])
    assert {t: k for t, k in keys.items() if not k[0].startswith("-")} == {
        "h1.o7.example": ["p:o7.example"], "h1.o8.example": ["p:o8.example"], "x.y.o7.example": ["p:o7.example"], "10.1.2.3": ["c4:00001010"],
        "11.0.0.0/9": ["c4:00001011"], "AS7": ["a:7"], "https://h1.o7.example/a": ["p:o7.example"]}
    assert all(len(keys[t]) == 1 for t in found)
    pairs = literal_table(spark, [(t, "P") for t in found], "target string, program_id string")
    got = {r["target"]: (r["allowed"], r["scope_id"]) for r in scope.evaluate_scope(pairs, rules).collect()}
    assert {t for t, (allowed, _) in got.items() if allowed} == {"h1.o7.example", "x.y.o7.example", "https://h1.o7.example/a"} and got["10.1.2.3"] == (False, "b") and len(got) == len(found)


def test_copies_of_a_large_rule_table_are_bounded(spark, monkeypatch):
    """Above the broadcast bound the rule keys are copied per salt only as far as the copies stay within a bound."""
    from palisade.operators import skew

    rules = rule_table(spark, [(f"r{i}", "P", "wildcard", "include", f"*.o{i}.example") for i in range(64)])
    targets = spark.range(3000).selectExpr("concat('h', id, '.o', id % 80, '.example') AS target")
    want = sorted(map(str, scope.evaluate_scope(targets, rules).collect()))
    size = scope.rule_table(rules).rows * scope.KEY_ROW_BYTES
    for bound, salted in ((size // 4, True), (size // 16, False)):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", bound)
        out = scope.evaluate_scope(targets, rules)
        assert sorted(map(str, out.collect())) == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("__salt" in plan) == salted


def test_targets_are_dealt_by_the_size_of_their_input(spark, monkeypatch, tmp_path):
    """The more input, the more tasks, whatever the session's number of shuffle partitions; the decisions stay the same."""
    from palisade.operators import skew

    rows = "concat('h', id % 4000, '.o', id % 50, '.example') AS target"
    for name, n in (("small", 40_000), ("large", 160_000)):
        spark.range(n).selectExpr(rows, "concat('pad', id) AS pad").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    small, large = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("small", "large"))
    rules = rule_table(spark, [("a", "P", "wildcard", "include", "*.o7.example"), ("b", "Q", "domain", "exclude", "h8.o8.example"), ("c", "Q", "wildcard", "include", "*.o8.example")])
    want = sorted(map(str, scope.evaluate_scope(large, rules).collect()))
    assert skew.tasks_by_input(large) is None and skew.tasks_by_input(spark.range(9).rdd.toDF()) is None
    monkeypatch.setattr(skew, "TASK_BYTES", 10_000)
    few, many = skew.tasks_by_input(small), skew.tasks_by_input(large)
    assert 8 < few and 3 * few < many < 5 * few
    got = scope.evaluate_scope(large, rules)
    assert sorted(map(str, got.collect())) == want
    assert got._jdf.queryExecution().executedPlan().toString().count(f", {skew.tasks_by_input(large.select('target'))}), REPARTITION_BY_NUM") >= 2
    pairs = large.crossJoin(spark.range(1).selectExpr("'Q' AS program_id"))
    assert {r["allowed"] for r in scope.evaluate_scope(pairs, rules).filter("target = 'h8.o8.example'").collect()} == {False}
    assert scope.scope_overall(large, rules).count() == 4000


def test_plan_has_no_nested_loop(spark, rules):
    targets = spark.range(10).selectExpr("concat('h', id, '.kettle.example') AS target", "'tea' AS program_id")
    plan = scope.evaluate_scope(targets, rules)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exclusion_lists(spark, rules):
    hosts = literal_table(spark, [("kettle.example", "tea"), ("old.attic.kettle.example", "tea"), ("elsewhere.example", "tea")], "host string, program_id string")
    got = {}
    for r in scope.host_exclusions(hosts, rules).collect():
        got.setdefault(r["host"], set()).add(r["excluded"])
    assert got["kettle.example"] == {"attic.kettle.example", "cellar.kettle.example", "198.51.100.40"}
    assert got["old.attic.kettle.example"] == {"attic.kettle.example", "198.51.100.40"}
    assert got["elsewhere.example"] == {"198.51.100.40"}
    one = literal_table(spark, [("shop.kettle.example", "tea")], "host string, program_id string")
    assert [r["url"] for r in scope.url_exclusions(one, rules).collect()] == ["https://shop.kettle.example/drafts"]


def test_exclusion_patterns(spark, rules):
    import re

    from palisade.functions.urls import normalize_urls

    origins = normalize_urls(literal_table(spark, [("https://shop.kettle.example/", "tea"), ("http://shop.kettle.example/", "tea")], "v string, program_id string"), "v", "url")
    (found,) = scope.exclusion_patterns(origins, rules).collect()
    hits = re.compile(found["pattern"]).search
    assert {p: bool(hits("https://shop.kettle.example" + p)) for p in ("/drafts", "/drafts/3?x=y", "/draftsman", "/")} == {"/drafts": True, "/drafts/3?x=y": True, "/draftsman": False, "/": False}


def test_output_validation_and_private_resolution(spark, rules):
    inside, page, far = "198.51.100.50", "https://green.kettle.example/", "https://elsewhere.example/"
    df = spark.createDataFrame([(t, "tea", ip, [inside]) for t in (page, far) for ip in (inside, "203.0.113.77")], "target string, program_id string, ip string, pinned array<string>")
    got = {(r["target"], r["ip"]): r["decision"]["allowed"] for r in scope.validate_output(df, rules, "target", "program_id", "ip", "pinned").collect()}
    assert {k for k, allowed in got.items() if allowed} == {(page, inside)} and len(got) == 4
    names = literal_table(spark, [(f"{i}.kettle.example", "tea", ip) for i, ip in enumerate(("192.168.3.3", inside, "9.9.9.9"))], "name string, program_id string, ip string")
    assert [(r["name"], r["first_bad_ip"]) for r in scope.private_resolution(names, rules).collect()] == [("0.kettle.example", "192.168.3.3")]


def test_many_excluded_networks_and_one_wide_target(spark):
    """Every excluded network touches the wide target; the rule keys hold one row per key and program, whatever their number."""
    rules = spark.range(20_000).selectExpr("lpad(cast(id AS string), 6, '0') AS rule_id", "'p' AS program_id", "'cidr' AS type", "'exclude' AS mode",
                                           "concat('10.', id div 250, '.', id % 250, '.0/24') AS value")
    checked = scope.scope_rules(rules)
    target = literal_table(spark, [("10.0.0.0/8", "p"), ("11.0.0.0/8", "p")], "target string, program_id string")
    got = {r["target"]: r["scope_id"] for r in scope.evaluate_scope(target, checked).collect()}
    assert got == {"10.0.0.0/8": "000000", "11.0.0.0/8": None}
    keys = scope.rule_table(checked).keys
    assert keys.groupBy("key").count().agg({"count": "max"}).first()[0] == 1
