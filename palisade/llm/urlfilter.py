"""URL filter: host and path rules first, then a path-template tree per host (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import LOWER, UPPER

#: Fixed rules of the registered query: host and path prefix, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
WILDCARD = "*"
SALTS = 32
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), UPPER, LOWER), F.regexp_extract(text, _URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one.  Rules of equal length that fit both: the one with the longer host.

    The rules are a short configured list (an argument), so they become one expression."""
    def fits(rule):
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    order = sorted(rules, key=lambda r: (-len(r[0]), -len(r[0].partition("/")[0]), r[0]))
    pick = lambda value: F.coalesce(*[F.when(fits(r), F.lit(value(r, v))) for r, v in order], F.lit(None).cast("string"))
    return pick(lambda r, v: r), pick(lambda r, v: v)


def templates(urls: DataFrame, min_support: int = 5, min_share: float = 0.05) -> DataFrame:
    """The rows (host, path, ...) with ``template``: the path with variable segments as wildcards.

    At a depth of a host, a segment is constant if it occurs at least ``min_support`` times and in at least ``min_share`` of the host's paths that
    are that deep; there are at most 1 / min_share of them.  The table of constants is repeated per salt, so that a host
    with a large part of all rows is spread."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    rows = urls.withColumn("__segments", segments)
    parts = rows.select("host", F.posexplode("__segments").alias("depth", "segment")).groupBy("host", "depth", "segment").agg(F.count(F.lit(1)).alias("n"))
    totals = parts.groupBy("host", "depth").agg(F.sum("n").alias("of"))
    known = parts.filter(F.col("n") >= min_support).join(totals, ["host", "depth"]).filter(F.col("n") >= F.col("of") * min_share)
    known = known.groupBy("host").agg(F.collect_list(F.concat_ws("/", "depth", "segment")).alias("__known"))
    known = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(known, ["host", "__salt"], "left")
    none = F.array().cast("array<string>")
    general = F.transform(F.col("__segments"), lambda s, i: F.when(F.array_contains(F.coalesce("__known", none), F.concat_ws("/", i.cast("string"), s)), s).otherwise(WILDCARD))
    return rows.withColumn("template", F.array_join(general, "/")).drop("__segments", "__salt", "__known")


def parent(template: Column) -> Column:
    """The template with its last constant segment generalised; null if it has none."""
    constant = template.rlike(r"(^|/)(?!\*(/|$))")
    return F.when(constant, F.regexp_replace(template, r"(^|/)(?!\*(?:/|$))[^/]*((?:/\*)*)$", r"$1*$2"))


def merged(stats: DataFrame, z: float = 1.96) -> DataFrame:
    """(host, template, merged): branches whose labels look like those of their siblings get the parent's template.

    ``stats``: host, template, bad, n (labelled).  A branch is compared with the other branches of the same parent by the test of two
    proportions; branches without labels, or without labelled siblings, stay: nothing shows that they are similar."""
    rows = stats.withColumn("parent", parent(F.col("template")))
    pool = rows.filter(F.col("parent").isNotNull()).groupBy("host", "parent").agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
    rows = rows.join(pool, ["host", "parent"], "left")
    others, other_bad = F.col("all_n") - F.col("n"), F.col("all_bad") - F.col("bad")
    p = F.try_divide(F.col("all_bad"), F.col("all_n"))
    gap = F.abs(F.try_divide(F.col("bad"), F.col("n")) - F.try_divide(other_bad, others))
    spread = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), others)))
    similar = (F.col("n") > 0) & (others > 0) & (gap <= z * spread)
    return rows.select("host", "template", F.when(similar, F.col("parent")).otherwise(F.col("template")).alias("merged"))


def judge(
    urls: DataFrame, labels: Column, strength: float = 2.0, reject: float = 0.9, min_support: int = 5, min_share: float = 0.05, z: float = 1.96,
) -> DataFrame:
    """The rows (host, path, ...) with ``template``, ``purity`` and ``template_verdict`` (allow or block).

    ``labels``: boolean column over the rows, true for bad, null for unlabelled.  A template's purity is its share of bad among labelled rows,
    smoothed by ``strength`` rows at the share among all labelled rows; it is blocked from ``reject`` on.  Without labels anywhere all is allowed.
    Paths without segments are one template; repeated rows count as often as they occur; an empty table gives no row.
    """
    rows = templates(urls.withColumn("__bad", labels), min_support, min_share)
    count = lambda c: F.count(F.when(c, 1))
    stats = rows.groupBy("host", "template").agg(count(F.col("__bad")).alias("bad"), F.count("__bad").alias("n"))
    joined = stats.join(merged(stats, z), ["host", "template"])
    whole = Window.partitionBy("host", "merged")
    share = stats.agg(F.try_divide(F.sum("bad"), F.sum("n")).alias("prior"))
    joined = joined.select("host", "template", "merged", F.sum("bad").over(whole).alias("bad"), F.sum("n").over(whole).alias("n"))
    prior = F.coalesce(share.select("prior").scalar(), F.lit(0.0))
    joined = joined.withColumn("purity", (F.col("bad") + strength * prior) / (F.col("n") + strength))
    verdicts = joined.select("host", "template", "merged", "purity", F.when(F.col("purity") >= reject, "block").otherwise("allow").alias("template_verdict"))
    verdicts = verdicts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return salted.join(verdicts, ["host", "template", "__salt"], "left").drop("__salt", "__bad")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity): one row per row of the input, whose other columns are not read.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are judged as paths of the host ''.  The rules' verdicts are the labels of
    the template tree; where no rule fits, the template decides."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "rule_verdict": verdict})
    judged = judge(rows, F.col("rule_verdict") == "block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "template_verdict").alias("verdict"), F.col("merged").alias("template"), "purity")


FILTER_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u),
v AS (SELECT *, row_number() OVER () AS row, string_split(regexp_replace(path, '^/', ''), '/') AS segments,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS rule_verdict FROM r),
e AS (SELECT row, host, generate_subscripts(segments, 1) AS depth, unnest(segments) AS segment FROM v),
c AS (SELECT host, depth, segment, count(*) AS n, sum(count(*)) OVER (PARTITION BY host, depth) AS total FROM e GROUP BY host, depth, segment),
k AS (SELECT row, e.depth, CASE WHEN n >= 5 AND n >= total * 0.05::DOUBLE THEN segment ELSE '*' END AS part FROM e JOIN c USING (host, depth, segment)),
t AS (SELECT row, string_agg(part, '/' ORDER BY depth) AS template FROM k GROUP BY row),
s AS (SELECT host, template, count(*) FILTER (rule_verdict = 'block') AS bad, count(rule_verdict) AS n FROM v JOIN t USING (row) GROUP BY host, template),
lists AS (SELECT *, string_split(template, '/') AS l FROM s),
cut AS (SELECT host, template, bad, n, l, list_max(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN l[i] <> '*' THEN i ELSE 0 END)) AS deep FROM lists),
p AS (SELECT host, template, bad, n, CASE WHEN deep > 0 THEN array_to_string(list_transform(l, lambda x, i: CASE WHEN i = deep THEN '*' ELSE x END), '/') END AS parent FROM cut),
w AS (SELECT *, sum(bad) OVER q AS all_bad, sum(n) OVER q AS all_n FROM p WINDOW q AS (PARTITION BY host, parent)),
m AS (SELECT host, template, bad, n, CASE WHEN parent IS NOT NULL AND n > 0 AND all_n > n AND
  abs(bad::DOUBLE / n - (all_bad - bad)::DOUBLE / (all_n - n)) <= 1.96 * sqrt((all_bad::DOUBLE / all_n) * (1 - all_bad::DOUBLE / all_n) * (1.0::DOUBLE / n + 1.0::DOUBLE / (all_n - n)))
  THEN parent ELSE template END AS merged FROM w),
y AS (SELECT host, template, sum(bad) OVER q AS bad, sum(n) OVER q AS n, coalesce((SELECT sum(bad)::DOUBLE / sum(n) FROM s), 0.0) AS prior FROM m WINDOW q AS (PARTITION BY host, merged))
SELECT page_id, v.host, path, rule, coalesce(rule_verdict, CASE WHEN (bad + 2.0::DOUBLE * prior) / (n + 2.0::DOUBLE) >= 0.9 THEN 'block' ELSE 'allow' END) AS verdict
FROM v JOIN t USING (row) JOIN y ON y.host = v.host AND y.template = t.template
"""
