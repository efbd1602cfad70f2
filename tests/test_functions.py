"""Expected values of the normalisers."""

from __future__ import annotations

import hashlib
import ipaddress
import random

from pyspark.sql import functions as F

from palisade.functions import addresses, names, targets, technology, urls, values
from palisade.functions.common import literal_table, shorten


def column(spark, items, name="v"):
    return literal_table(spark, [(i,) for i in items], f"{name} string")


def as_map(df, key, value):
    return {r[0]: r[1] for r in df.select(key, value).collect()}


def test_domains(spark):
    good = {"Mill.Orchard.TEST": "mill.orchard.test", "orchard.test.": "orchard.test", "\tpear.orchard.test\n": "pear.orchard.test", "_srv._tcp.orchard.test": "_srv._tcp.orchard.test", "9.orchard.test": "9.orchard.test"}
    bad = {
        "orchard": "too_few_labels", "pear..orchard.test": "empty_label", ".orchard.test": "empty_label", "-pear.orchard.test": "invalid_label", "pear-.orchard.test": "invalid_label",
        "pear.77": "invalid_top_level", f"{'p' * 64}.test": "invalid_label", "pe ar.test": "forbidden_characters", "pear/plum.test": "invalid_characters", "": "empty",
        ".".join(["p" * 60] * 5) + ".test": "too_long",
    }
    df = names.normalize_domains(column(spark, [*good, *bad]), "v")
    assert as_map(df, "v", "domain.value") == {**good, **dict.fromkeys(bad)}
    assert as_map(df, "v", "domain.error") == {**dict.fromkeys(good), **bad}


def test_international_names(spark):
    want = {"birnen.straße.test": "birnen.xn--strae-oqa.test", "GRÜN.test": "xn--grn-ioa.test", "plain.test": "plain.test", "pear\u2028.test": None}
    df = column(spark, list(want))
    assert as_map(names.normalize_domains(df, "v"), "v", "domain.value") == want
    assert as_map(names.normalize_domains(df, "v", idn=False), "v", "domain.error")["GRÜN.test"] == "invalid_idn"
    got = as_map(urls.normalize_urls(column(spark, ["https://grün.test/ä"]), "v"), "v", "u.value")
    assert got == {"https://grün.test/ä": "https://xn--grn-ioa.test/%C3%A4"}
    assert as_map(targets.classify(column(spark, ["*.grün.test"]), "v"), "v", "t.value") == {"*.grün.test": "*.xn--grn-ioa.test"}


def test_wildcards(spark):
    suffixes = ("test", "fruit.test", "*.market", "!stall.market")
    want = {
        "*.Orchard.fruit.test": "*.orchard.fruit.test", "*.orchard.test": "*.orchard.test", "*.stall.market": "*.stall.market", "*.a.b.market": "*.a.b.market",
        "*.test": None, "*.fruit.test": None, "*.b.market": None, "pear*.orchard.test": None, "*orchard.test": None, "*.*.orchard.test": None, "orchard.test": None,
    }
    assert as_map(names.normalize_wildcards(column(spark, list(want)), "v", suffixes=suffixes), "v", "wildcard.value") == want


def test_public_suffixes(spark):
    df = column(spark, ["www.example.co.uk", "example.com", "co.uk", "host.internal", "a.b.ck", "x.a.b.ck", "www.ck", "z.www.ck"])
    got = as_map(df.withColumn("r", names.registrable_domain(F.col("v"))), "v", "r")
    assert got == {
        "www.example.co.uk": "example.co.uk", "example.com": "example.com", "co.uk": None, "host.internal": "internal",
        "a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "www.ck": "www.ck", "z.www.ck": "www.ck",
    }


def test_addresses_match_the_standard_library(spark):
    rnd = random.Random(7)
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1", "1:", "::ffff:192.0.2.10", "::1.2.3.4",
             "1:2:3:4:5:6:1.2.3.4", "::1.2.3.400", "2001:DB8:0:0:0:0:0:1", "1:0:0:2:0:0:0:3", "0:0:1:0:0:1:0:0", "12345::", "g::"]
    for _ in range(200):
        words = [rnd.choice(["0", "0", "0", f"{rnd.getrandbits(16):x}"]) for _ in range(8)]
        texts.append(":".join(words))
    got = {r["v"]: r["ip"] for r in addresses.normalize_ips(column(spark, texts), "v").collect()}
    for text in texts:
        try:
            ip = ipaddress.ip_address(text)
            ip = getattr(ip, "ipv4_mapped", None) or ip
        except ValueError:
            ip = None
        assert got[text]["value"] == (str(ip) if ip else None), text
        if ip:
            assert got[text]["bits"] == f"{int(ip):0{ip.max_prefixlen}b}"


def test_cidrs(spark):
    texts = ["10.0.0.0/8", "10.0.0.5/24", "2001:db8::/32", "2001:db8::1/32", "1.2.3.0/255.255.255.0", "1.2.3.0/0.0.0.255",
             "1.2.3.4", "1.2.3.4/33", "x/8", "0.0.0.0/0", "::/0", "1.2.3.4/8/8", "not-a-cidr"]
    for strict in (True, False):
        got = as_map(addresses.normalize_cidrs(column(spark, texts), "v", strict=strict), "v", "cidr.value")
        for text in texts:
            try:
                want = str(ipaddress.ip_network(text, strict=strict)) if "/" in text or not strict else None
            except ValueError:
                want = None
            assert got[text] == want, (text, strict)


def test_sensitive_addresses(spark):
    yes = ["127.0.0.1", "169.254.169.254", "100.64.0.1", "::1", "0.0.0.0", "10.0.0.5", "192.168.1.1", "224.0.0.1", "fe80::1", "fc00::1", "ff02::1", "2001:db8::1"]
    no = ["8.8.8.8", "52.1.2.3", "2606:4700::1", "192.0.0.9", "100.128.0.1"]
    df = addresses.with_ip_bits(column(spark, yes + no), F.col("v"), "b").withColumn("s", addresses.is_sensitive(F.col("b")))
    assert {k for k, v in as_map(df, "v", "s").items() if v} == set(yes)


def test_asns(spark):
    got = as_map(targets.normalize_asns(column(spark, ["AS64500", "as1", "64500", "AS0", "AS4294967296", "ASX", "AS4294967295"]), "v"), "v", "asn.value")
    assert got == {"AS64500": 64500, "as1": 1, "64500": 64500, "AS0": None, "AS4294967296": None, "ASX": None, "AS4294967295": 4294967295}


def test_urls(spark):
    want = {  # default port, dot segments, fragment, order of the query, percent forms, address hosts
        "HTTP://Pear.Orchard.test:80/a/b/../c/./d#top": "http://pear.orchard.test/a/c/d",
        "https://pear.orchard.test?b=2&a=1&a=0": "https://pear.orchard.test/?a=0&a=1&b=2",
        "https://pear.orchard.test:8443/": "https://pear.orchard.test:8443/",
        "https://[2001:DB8:0::5]/x": "https://[2001:db8::5]/x",
        "https://pear.orchard.test/one/%2E%2E/two": "https://pear.orchard.test/two",
        "http://pear.orchard.test//two//three/": "http://pear.orchard.test/two/three/",
    }
    df = urls.normalize_urls(column(spark, [*want]), "v")
    assert as_map(df, "v", "u.value") == want
    got = {r["v"]: r["u"] for r in df.collect()}
    query = got["https://pear.orchard.test?b=2&a=1&a=0"]
    assert query["parameters"] == ["a", "b"] and query["port"] == 443 and query["origin"] == "https://pear.orchard.test"
    assert query["url_hash"] == hashlib.sha256(query["value"].encode()).hexdigest()
    assert query["endpoint_hash"] == hashlib.sha256(b"https://pear.orchard.test/|a,b").hexdigest()
    other = urls.normalize_urls(column(spark, ["https://pear.orchard.test/?b=&a=9"]), "v").first()["u"]
    assert other["endpoint_hash"] == query["endpoint_hash"] and other["url_hash"] != query["url_hash"]
    bad = ["https://me:pw@pear.orchard.test/", "https://pear.orchard.test\\@plum.test/", "data:text/plain,x", "mailto:a@orchard.test", "https://pear.orchard.test:0/", "https://pear.orchard.test:65536/",
           "https://[10.0.0.1]/", "https:///path", "https://[2001:db8::5/", "https://pear.orchard.test/%00", "https://pe ar.orchard.test/"]
    assert set(as_map(urls.normalize_urls(column(spark, bad), "v"), "v", "u.value").values()) == {None}


def test_classification(spark):
    of_kind = {
        "domain": ["orchard.test", "asparagus.orchard.test"], "wildcard": ["*.pear.orchard.test"], "ipv4": ["203.0.113.5"], "ipv6": ["2001:db8::5", "::"], "cidr": ["203.0.113.0/28", "2001:db8::/33"],
        "asn": ["AS65010", "as7"], "url": ["http://orchard.test/x"], None: ["", "203.0.113", "0x7f000001", "017.0.0.1", "fe80::7%3", "orchard.test:22", "AS"],
    }
    want = {v: k for k, values in of_kind.items() for v in values}
    assert as_map(targets.classify(column(spark, list(want)), "v"), "v", "t.kind") == want


def test_scope_values(spark):
    want = {("asn", "65010"): "AS65010", ("ipv6", "2001:DB8::0:5"): "2001:db8::5", ("url", "HTTPS://Orchard.test"): "https://orchard.test/", ("cidr", "203.0.113.0/28"): "203.0.113.0/28",
            ("ipv6", "203.0.113.5"): None, ("wildcard", "orchard.test"): None, ("cidr", "203.0.113.5/28"): None, ("port", "443"): None}
    df = targets.normalize_scope_values(literal_table(spark, list(want), "type string, v string"), "type", "v")
    assert {(r["type"], r["v"]): r["scope"]["value"] for r in df.collect()} == want


def test_asset_types(spark):
    df = targets.classify(column(spark, ["example.com", "a.example.com", "1.2.3.4"]), "v")
    got = as_map(df.withColumn("a", targets.asset_type(F.col("t.kind"), F.col("t.value"))), "v", "a")
    assert got == {"example.com": "domain", "a.example.com": "subdomain", "1.2.3.4": "ipv4"}


def test_durations_and_expiry(spark):
    df = column(spark, ["12.5ms", "830µs", "1.5s", "x", "ms", "3m"])
    assert as_map(df.withColumn("m", values.duration_ms(F.col("v"))), "v", "m") == {
        "12.5ms": 12.5, "830µs": 0.83, "1.5s": 1500.0, "x": None, "ms": None, "3m": None,
    }
    now = F.lit("2026-10-02").cast("timestamp")
    df = column(spark, ["2026-09-01", "2026-10-20", "2027-01-01"])
    ts = F.col("v").cast("timestamp")
    got = as_map(df.withColumn("s", values.expiry_status(ts, now)), "v", "s")
    assert list(got.values()) == ["expired", "expiring", "valid"]
    assert as_map(df.withColumn("s", values.days_until_expiry(ts, now)), "v", "s")["2026-10-20"] == 18.0


def test_name_flags(spark):
    df = column(spark, ["shop.example.tk", "1secure.example.com", "*.123.example.com", "xn--bcher-kva.example", "api.example.com"])
    got = as_map(df.withColumn("f", names.name_flags(F.col("v"))), "v", "f")
    assert list(got.values()) == [["suspicious_tld"], ["numeric"], ["numeric"], ["punycode"], []]
    every = df.agg(F.collect_list("v").alias("v")).select(names.certificate_flags(F.col("v")))
    assert every.first()[0] == ["numeric", "punycode", "suspicious_tld"]


def test_technologies(spark):
    def names_of(texts, fn):
        return {r[0]: r[1] for r in column(spark, texts).select("v", fn(F.col("v"))).collect()}

    got = names_of(["Tea Pot!", "Tea Pot!:3.2.1", "Tea Pot!:soon", "NGINX:1.9"], technology.from_fingerprint)
    assert {got[k]["name"] for k in list(got)[:3]} == {"tea-pot"}
    assert [got[k]["version"] for k in got] == [None, "3.2.1", None, "1.9"]
    assert (got["NGINX:1.9"]["product"], got["NGINX:1.9"]["confidence"], got["NGINX:1.9"]["version_confidence"]) == ("nginx", 0.8, 0.7)
    assert got["Tea Pot!"]["version_confidence"] is None
    got = names_of(["kettle/0.9 (steam)", "Apache", "/"], technology.from_server_header)
    assert (got["kettle/0.9 (steam)"]["name"], got["kettle/0.9 (steam)"]["version"]) == ("kettle", "0.9")
    assert got["Apache"]["name"] == "apache-httpd" and got["/"] is None
    got = names_of(["cpe:/a:teaworks:pot_lid:4.1", "cpe:2.3:a:teaworks:kettle:*:*", "cpe:teaworks"], technology.from_cpe)
    assert (got["cpe:/a:teaworks:pot_lid:4.1"]["vendor"], got["cpe:/a:teaworks:pot_lid:4.1"]["name"]) == ("teaworks", "pot-lid")
    assert got["cpe:2.3:a:teaworks:kettle:*:*"]["version"] is None and got["cpe:teaworks"] is None


def test_merge_prefers_versioned_then_confident_then_first(spark):
    df = column(spark, ["Nginx,Ubuntu,HSTS"]).select(
        technology.merge_technologies(
            F.concat(
                F.transform(F.split("v", ","), technology.from_fingerprint),
                F.array(technology.from_server_header(F.lit("nginx/1.25.1"))),
            )
        ).alias("t")
    )
    got = df.first()["t"]
    assert [(t["name"], t["version"]) for t in got] == [("hsts", None), ("nginx", "1.25.1"), ("ubuntu", None)]


def test_cpe_candidates(spark):
    rows = [("nginx", "1.24.0", None), ("nginx", None, None), ("nginx", "latest", None), ("someapp", "2.0", None),
            ("someapp", "2.0", "cpe:/a:acme:someapp"), ("nginx", "1.0:*:*", None)]
    df = technology.with_cpe_candidate(literal_table(spark, rows, "t string, v string, c string"), "t", "v", "c")
    got = [r["candidate"] for r in df.collect()]
    assert got[0]["cpe"] == "cpe:2.3:a:f5:nginx:1.24.0:*:*:*:*:*:*:*" and got[0]["level"] == "high"
    assert got[1] is got[2] is got[3] is got[5] is None
    assert got[4]["cpe"].startswith("cpe:2.3:a:acme:someapp:2.0:") and got[4]["level"] == "medium"


def test_shorten_and_hash(spark):
    df = column(spark, ["abcdef", "abc"]).select("v", shorten(F.col("v"), 4).alias("s"))
    assert as_map(df, "v", "s") == {"abcdef": "abc…", "abc": "abc"}
    row = spark.range(1).select(
        values.stable_hash(a=F.lit(1), b=F.lit(None).cast("string")).alias("x"),
        values.stable_hash(b=F.lit(None).cast("string"), a=F.lit(1)).alias("y"),
    ).first()
    assert row["x"] == row["y"] and len(row["x"]) == 64
