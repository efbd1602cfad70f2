"""Scope decisions as one equi-join.

Rules and targets are both turned into *probe keys*, chosen so that key equality already means "the rule touches
the target":

====  ==========================================================  =========================================
key   emitted by a rule                                           probed by a target
====  ==========================================================  =========================================
e     domain rule: its name                                       host name itself
p     wildcard rule, excluding domain rule: the name              every parent of the host name
c     network rule: its prefix bits                               its own prefixes of the rule lengths in use
r     excluding network rule: every shorter prefix                CIDR target: its own bits
u     URL rule: scheme, host, port (path checked afterwards)      URL target: the same
h     excluding whole-origin URL rule: host name                  domain target: host name
y     the same for an address host: every prefix of it            address and CIDR targets: own bits
a     ASN rule                                                    ASN target
====  ==========================================================  =========================================

A target probes only kinds, numbers of labels and prefix lengths that the rules use, so most keys are never made.
Rules are broadcast while their size allows, otherwise joined by a shuffle.  Every distinct target is
evaluated once, however often it occurs.  Precedence inside a program: exclusion, explicit inclusion, wildcard
inclusion, deny.  Ties: the exclusion with the most specific name, then the smallest rule id.
"""

from __future__ import annotations

import weakref
from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.addresses import is_sensitive, with_ip_bits
from palisade.functions.common import REST, lookup, opaque, recorded
from palisade.functions.names import host_suffixes, label_count
from palisade.functions.targets import classify, normalize_scope_values
from palisade.operators.skew import BROADCAST_BYTES, dealt, estimated_bytes, lookup_join, tasks_by_input
from palisade.session import scratch_dir

KEY_ROW_BYTES = 250  # of a broadcast rule key with its decision
_DENY = "not in approved scope"
_NO_KEY = "-"


def scope_rules(rules: DataFrame, *, idn: bool = True, suffixes: Collection[str] = K.PUBLIC_SUFFIXES) -> DataFrame:
    """Validated rules from (rule_id, program_id, type, mode, value[, program_name]).

    ``suffixes``: public suffixes, over which no wildcard is accepted; pass the full list in production, as a suffix that is missing is not refused.
    Adds ``error``; a caller that must fail closed checks that no row has one (see ``streaming.route``).
    """
    if estimated_bytes(rules) < BROADCAST_BYTES:
        # small in bytes but costly per row, and often a single file: spread the rows over some cores
        rules = rules.repartition(min(64, rules.sparkSession.sparkContext.defaultParallelism))
    df = rules if "program_name" in rules.columns else rules.withColumn("program_name", F.lit(None).cast("string"))
    return _rule_columns(normalize_scope_values(df, "type", "value", "__n", idn=idn, suffixes=tuple(suffixes)))


@recorded
def _rule_columns(df: DataFrame) -> DataFrame:
    n = F.col("__n")
    mode_error = F.when(~F.col("mode").isin("include", "exclude") | F.col("mode").isNull(), "unsupported_mode")
    base = F.when(n["type"] == "wildcard", F.substring(n["value"], 3, REST)).when(n["type"] == "domain", n["value"])
    return df.select(
        "rule_id", "program_id", "program_name", "mode", n["type"].alias("type"), n["value"].alias("value"),
        F.coalesce(n["error"], mode_error).alias("error"), base.alias("base"), n["ip_version"].alias("ip_version"),
        n["net_bits"].alias("net_bits"), n["asn"].alias("asn"), n["url"]["scheme"].alias("url_scheme"),
        n["url"]["host"].alias("url_host"), n["url"]["host_type"].alias("url_host_type"),
        n["url"]["port"].alias("url_port"), n["url"]["path"].alias("url_path"),
    )


def _prefix_keys(tag: str, bits: Column, version: Column, lengths: Column) -> Column:
    return F.transform(
        lengths, lambda k: F.concat(F.lit(tag), version.cast("string"), F.lit(":"), F.substring(bits, F.lit(1), k))
    )


def _none() -> Column:
    return F.array().cast("array<string>")


@recorded
def _rule_keys(rules: DataFrame) -> DataFrame:
    r = F.col
    excl = r("mode") == "exclude"
    bits, ver = r("net_bits"), r("ip_version")
    n = F.length(bits)
    net_type = r("type").isin("cidr", "ipv4", "ipv6")
    whole_origin = (r("type") == "url") & excl & (r("url_path") == "/")
    keys = (
        F.when((r("type") == "domain") & excl, F.array(F.concat(F.lit("e:"), r("base")), F.concat(F.lit("p:"), r("base"))))
        .when(r("type") == "domain", F.array(F.concat(F.lit("e:"), r("base"))))
        .when(r("type") == "wildcard", F.array(F.concat(F.lit("p:"), r("base"))))
        .when(
            net_type,
            F.concat(
                _prefix_keys("c", bits, ver, F.array(n)),
                F.when(excl & (n > 0), _prefix_keys("r", bits, ver, F.sequence(F.lit(0), n - 1))).otherwise(_none()),
            ),
        )
        .when(
            r("type") == "url",
            F.concat(
                F.array(F.concat_ws("|", F.concat(F.lit("u:"), r("url_scheme")), r("url_host"), r("url_port").cast("string"))),
                F.when(whole_origin & (r("url_host_type") == "domain"), F.array(F.concat(F.lit("h:"), r("url_host"))))
                .when(whole_origin, _prefix_keys("y", bits, ver, F.sequence(F.lit(0), n)))
                .otherwise(_none()),
            ),
        )
        .when(r("type") == "asn", F.array(F.concat(F.lit("a:"), r("asn").cast("string"))))
    )
    wildcard = r("type") == "wildcard"
    rank = F.when(wildcard, 0).otherwise(K.EXPLICIT_BONUS) + lookup(K.SPECIFICITY, r("type"))
    # smallest wins: exclusions first, the most specific name first; then inclusions, highest rank first
    order = F.when(excl, F.when(r("base").isNotNull(), -label_count(r("base"))).otherwise(0)).otherwise(-rank)
    decision = F.struct(
        F.when(excl, 0).otherwise(1).alias("turn"), order.alias("position"), r("rule_id").alias("rule_id"),
        r("type").alias("type"), r("value").alias("value"), r("program_name").alias("program_name"),
    )
    return rules.filter(r("error").isNull()).select(
        F.explode(keys).alias("key"), r("program_id"), r("url_path").alias("rule_path"), decision.alias("rule")
    )


def _best_per_key(keys: DataFrame) -> DataFrame:
    """One row per key and program: of several rules only the best can decide.  URL keys keep one row per path, as the path is checked later.

    So a short prefix that every excluded network emits stays a single row."""
    path = F.when(F.startswith("key", F.lit("u:")), F.col("rule_path"))
    best = keys.groupBy("key", "program_id", path.alias("rule_path")).agg(F.min("rule").alias("rule"))
    return best.select("key", "program_id", "rule_path", "rule")


@dataclass(frozen=True)
class RuleTable:
    """Keys of a rule set as a written table, its number of rows, and which keys are in use: kinds (for networks with the version), each with its prefix
    lengths or its numbers of labels."""

    path: str
    keys: DataFrame
    uses: tuple[tuple[str, int], ...]
    rows: int


_TABLES: weakref.WeakKeyDictionary[DataFrame, RuleTable] = weakref.WeakKeyDictionary()


def rule_table(rules: DataFrame) -> RuleTable:
    """Normalise and key a rule set once, however many decisions use it.

    The keys are written to the shared scratch folder, so the size of what may be broadcast is known exactly.  Of the
    profile at most 869 rows come to the driver, whatever the number of rules."""
    if rules not in _TABLES:
        spark = rules.sparkSession
        path = scratch_dir(spark, "scope-rules")
        _best_per_key(_rule_keys(rules)).write.parquet(path)
        keys = spark.read.parquet(path)
        kind = F.substring_index("key", ":", 1)
        n = F.when(F.length(kind) == 2, F.length("key") - 3).when(kind.isin("e", "p", "h"), label_count(F.substring("key", 3, REST))).otherwise(0)
        profile = keys.groupBy(kind.alias("kind"), n.alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
        uses = tuple(sorted((r["kind"], r["n"]) for r in profile))
        _TABLES[rules] = RuleTable(path, keys, uses, sum(r["rows"] for r in profile))
    return _TABLES[rules]


def drop_rule_table(rules: DataFrame) -> None:
    """Delete the keys of a rule set that has been superseded."""
    table = _TABLES.pop(rules, None)
    if table is not None:
        path = rules.sparkSession._jvm.org.apache.hadoop.fs.Path(table.path)
        path.getFileSystem(rules.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _target_keys(t: Column, uses: tuple[tuple[str, int], ...]) -> Column:
    host, bits, ver, url = t["host"], t["net_bits"], t["ip_version"], t["url"]
    numbers = lambda kind: [n for k, n in uses if k == kind]
    keys: list[Column] = []

    def add(when: Column, made: Column) -> None:
        keys.append(F.when(when, made).otherwise(_none()))

    for kind in ("e", "h"):
        if numbers(kind):
            fits = label_count(host).isin(numbers(kind))
            add(fits & (t["kind"] == "domain") if kind == "h" else fits, F.array(F.concat(F.lit(f"{kind}:"), host)))
    if numbers("p"):
        above = F.filter(F.array(*map(F.lit, numbers("p"))).cast("array<int>"), lambda k: k < label_count(host))
        add(host.isNotNull(), F.transform(above, lambda k: F.concat(F.lit("p:"), F.call_function("substring_index", host, F.lit("."), -k))))
    for version in (4, 6):
        here = bits.isNotNull() & ((ver == 4) if version == 4 else ~ver.eqNullSafe(4))
        if lengths := numbers(f"c{version}"):
            add(here, _prefix_keys("c", bits, ver, F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length(bits))))
        for kind, of_kind in (("r", t["kind"] == "cidr"), ("y", t["kind"] != "url")):
            if lengths := numbers(f"{kind}{version}"):
                add(here & of_kind & F.length(bits).isin(lengths), _prefix_keys(kind, bits, ver, F.array(F.length(bits))))
    if numbers("u"):
        add(t["kind"] == "url", F.array(F.concat_ws("|", F.concat(F.lit("u:"), url["scheme"]), url["host"], url["port"].cast("string"))))
    if numbers("a"):
        add(t["kind"] == "asn", F.array(F.concat(F.lit("a:"), t["asn"].cast("string"))))
    made = F.concat(*keys) if keys else _none()
    # a target without keys still needs a row, so that it gets its deny decision; such rows are not to meet in one task
    return F.when(t["error"].isNull() & (t["kind"] != "wildcard") & (F.size(made) > 0), made).otherwise(
        F.array(F.concat(F.lit(_NO_KEY), F.coalesce(F.col("target"), F.lit(""))))
    )


def _matches(targets: DataFrame, rules: DataFrame, ids: list[str], idn: bool, hits_only: bool = False) -> DataFrame:
    """(ids, kind, value, error, program_id, rule): left outer, so targets without a match keep one row, unless ``hits_only``.

    Many targets are dealt over as many tasks as their input needs, before and after the lookup: distinct texts and hits take memory by the row."""
    tasks = tasks_by_input(targets.select(*ids))
    classified = classify(dealt(targets.select(*ids), tasks, ids).distinct(), "target", "__t", idn=idn)
    table = rule_table(rules)
    probes = _probes(classified, tuple(ids), table.uses)
    if hits_only:
        probes = probes.filter(~F.startswith("key", F.lit(_NO_KEY)))
    on = ["key", "program_id"] if "program_id" in ids else ["key"]
    joined = lookup_join(probes, table.keys, on, "inner" if hits_only else "left", spread=["target"], size=table.rows * KEY_ROW_BYTES)
    return dealt(_checked_paths(joined, tuple(ids)), tasks, ids)


@recorded
def _probes(classified: DataFrame, ids: tuple[str, ...], uses: tuple[tuple[str, int], ...]) -> DataFrame:
    t = F.col("__t")
    return opaque(
        classified, __kind=t["kind"], __value=t["value"], __error=t["error"], __path=t["url"]["path"], __keys=_target_keys(t, uses)
    ).select(*ids, "__kind", "__value", "__error", "__path", F.explode("__keys").alias("key"))


@recorded
def _checked_paths(joined: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    prefix = F.rtrim(F.col("rule_path"), F.lit("/"))
    path_ok = (
        ~F.startswith(F.col("key"), F.lit("u:"))
        | (F.col("rule_path") == "/")
        | (F.col("__path") == prefix)
        | F.startswith(F.col("__path"), F.concat(prefix, F.lit("/")))
    )
    return joined.select(
        *ids, F.col("__kind").alias("kind"), F.col("__value").alias("value"), F.col("__error").alias("error"),
        *([] if "program_id" in ids else [F.when(path_ok, F.col("program_id")).alias("program_id")]),
        F.when(path_ok, F.col("rule")).alias("rule"),
    )


def _decided(best: Column) -> dict[str, Column]:
    excluded, included = best["turn"] == 0, best["turn"] == 1
    wildcard = best["type"] == "wildcard"
    return {
        "allowed": F.coalesce(included, F.lit(False)),
        "match_kind": F.when(excluded, "explicit_exclusion")
        .when(included & wildcard, "wildcard_inclusion")
        .when(included, "explicit_inclusion")
        .otherwise("none"),
        "scope_id": best["rule_id"],
        "program_name": best["program_name"],
        "reason": F.when(
            excluded, F.concat(F.lit("excluded by exclude "), best["type"], F.lit(" "), best["value"])
        )
        .when(included & wildcard, F.concat(F.lit("matched "), best["value"], F.lit(" (wildcard)")))
        .when(included, F.concat(F.lit("matched "), best["value"]))
        .otherwise(_DENY),
    }


@recorded
def _with_decision_columns(grouped: DataFrame) -> DataFrame:
    return _refused(opaque(grouped, **_decided(F.col("__best"))).drop("__best"))


def _refused(df: DataFrame) -> DataFrame:
    """Reasons of targets that are never evaluated."""
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("invalid target: "), F.col("error")))
        .when(F.col("kind") == "wildcard", F.lit("wildcard patterns are not scannable targets"))
        .otherwise(F.col("reason"))
    )
    return df.withColumn("reason", reason)


def evaluate_scope(targets: DataFrame, rules: DataFrame, *, idn: bool = True) -> DataFrame:
    """Decision of each distinct target in each program with a matching rule.

    With a ``program_id`` column in ``targets`` each (target, program) pair is decided and deny rows are present;
    without it the result lists only programs whose rules touch the target (all others deny).
    ``rules`` comes from :func:`scope_rules`.
    """
    pairs = "program_id" in targets.columns
    ids = ["target", "program_id"] if pairs else ["target"]
    hits = _matches(targets, rules, ids, idn, hits_only=not pairs)
    if not pairs:
        hits = hits.filter(F.col("rule").isNotNull())
    grouped = hits.groupBy("target", "program_id").agg(
        F.first("kind").alias("kind"), F.first("value").alias("value"), F.first("error").alias("error"),
        F.min("rule").alias("__best"),
    )
    return _with_decision_columns(grouped)


def scope_overall(targets: DataFrame, rules: DataFrame, *, idn: bool = True) -> DataFrame:
    """One decision per distinct target over all programs: allowed if any allows (``allowed_programs``), else the
    first exclusion, else deny.  "First" is the smallest program id."""
    hits = _matches(targets.select("target"), rules, ["target"], idn)
    per_program = hits.groupBy("target", "program_id").agg(
        F.first("kind").alias("kind"), F.first("value").alias("value"), F.first("error").alias("error"),
        F.min("rule").alias("rule"),
    )
    turn = F.col("rule.turn")
    preference = F.struct(
        F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2).alias("p"), F.col("program_id").alias("program_id"),
        F.col("rule").alias("rule"),
    )
    rolled = per_program.groupBy("target").agg(
        F.first("kind").alias("kind"), F.first("value").alias("value"), F.first("error").alias("error"),
        F.min(preference).alias("__first"),
        # at most one entry per program
        F.array_sort(F.collect_set(F.when(turn == 1, F.col("program_id")))).alias("allowed_programs"),
    )
    out = opaque(rolled, program_id=F.col("__first.program_id"), **_decided(F.col("__first.rule"))).drop("__first")
    return _refused(out)


def with_decision(rows: DataFrame, rules: DataFrame, target: str, program: str, *, idn: bool = True) -> DataFrame:
    """Attach ``decision`` (struct) to every row: distinct (target, program) pairs are decided once, then joined."""
    pairs = rows.select(F.col(target).alias("target"), F.col(program).alias("program_id"))
    decided = evaluate_scope(pairs, rules, idn=idn)
    fields = ["kind", "value", "error", "allowed", "match_kind", "scope_id", "program_name", "reason"]
    slim = decided.select(
        F.col("target").alias(target), F.col("program_id").alias(program), F.struct(*fields).alias("decision")
    )
    return rows.join(slim, [target, program], "left")


def validate_output(rows: DataFrame, rules: DataFrame, target: str, program: str, ip: str | None = None,
                    pinned: str | None = None) -> DataFrame:
    """Check what a tool reports it touched: the target must be in scope and, when addresses were validated before
    (array column ``pinned``, not empty), the contacted address must be one of them."""
    df = with_decision(rows, rules, target, program)
    if ip is None or pinned is None:
        return df
    d = F.col("decision")
    drift = d["allowed"] & F.col(ip).isNotNull() & (F.size(pinned) > 0) & ~F.array_contains(F.col(pinned), F.col(ip))
    refused = d.withField("allowed", F.lit(False)).withField("match_kind", F.lit("none")).withField(
        "scope_id", F.lit(None).cast("string")
    ).withField("reason", F.concat(F.lit("connected IP "), F.col(ip), F.lit(" differs from validated IPs")))
    return df.withColumn("decision", F.when(F.coalesce(drift, F.lit(False)), refused).otherwise(d))


def private_resolution(resolutions: DataFrame, rules: DataFrame) -> DataFrame:
    """Names that resolve to sensitive addresses which are not themselves in scope.

    ``resolutions``: (name, program_id, ip).  One row per offending (name, program) with its sorted addresses."""
    df = with_ip_bits(resolutions.select("name", "program_id", "ip").distinct(), F.col("ip"), "__bits")
    bad = df.filter(is_sensitive(F.col("__bits"))).select("name", "program_id", "ip")
    decided = with_decision(bad, rules, "ip", "program_id").filter(~F.col("decision.allowed"))
    return decided.groupBy("name", "program_id").agg(
        F.count(F.lit(1)).alias("bad_ips"), F.min("ip").alias("first_bad_ip"), F.max("ip").alias("last_bad_ip")
    )


def host_exclusions(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, program_id, excluded): excluded names equal to, above or below each host, plus the program's excluded
    networks.  ``hosts``: (host, program_id)."""
    pairs = hosts.select("host", "program_id").distinct()
    excl = rules.filter((F.col("mode") == "exclude") & F.col("error").isNull())
    names = excl.filter(F.col("base").isNotNull()).select("program_id", F.col("base").alias("excluded"))
    above = pairs.select("host", "program_id", F.explode(host_suffixes(F.col("host"))).alias("excluded"))
    below = names.select("program_id", "excluded", F.explode(host_suffixes(F.col("excluded"))).alias("host"))
    nets = excl.filter(F.col("type").isin("cidr", "ipv4", "ipv6")).select("program_id", F.col("value").alias("excluded"))
    columns = ["host", "program_id", "excluded"]
    return (
        lookup_join(above, names.distinct(), ["program_id", "excluded"], "inner").select(columns)
        .unionByName(lookup_join(pairs, below.distinct(), ["program_id", "host"], "inner", fanout=127).select(columns))
        .unionByName(lookup_join(pairs, nets.distinct(), ["program_id"], "inner").select(columns))
        .distinct()
    )


def url_exclusions(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, program_id, rule_id, url, url_scheme, url_port, url_path) of URL exclusions on each host."""
    excl = rules.filter((F.col("mode") == "exclude") & (F.col("type") == "url") & F.col("error").isNull()).select(
        "program_id", F.col("url_host").alias("host"), "rule_id", F.col("value").alias("url"), "url_scheme", "url_port", "url_path"
    )
    return lookup_join(hosts.select("host", "program_id").distinct(), excl, ["host", "program_id"], "inner")


def exclusion_patterns(origins: DataFrame, rules: DataFrame) -> DataFrame:
    """Anchored regular expressions that keep a crawl of each origin out of its excluded paths.

    ``origins``: (program_id, url) with ``url`` from ``normalize_urls``."""
    u = F.col("url")
    starts = origins.select("program_id", u["host"].alias("host"), u["scheme"].alias("url_scheme"),
                            u["port"].alias("url_port"), u["origin"].alias("origin")).distinct()
    excl = url_exclusions(starts, rules).select("program_id", "host", "url_scheme", "url_port", "url_path")
    path = F.rtrim(F.col("url_path"), F.lit("/"))
    path = F.when(path == "", "/").otherwise(path)
    hits = lookup_join(starts, excl.distinct(), ["program_id", "host", "url_scheme", "url_port"], "inner")
    escape = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9_/:!\"%',;<=>@`])", r"\\$1")
    pattern = F.concat(F.lit("^"), escape(F.col("origin")), escape(path), F.lit(r"(/|\?|#|$)"))
    return hits.select("program_id", "origin", pattern.alias("pattern")).distinct()
