"""Technology fingerprints, versions and CPE candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.common import blank_to_null, let, lookup, opaque, recorded, strip

_VENDORS = {k: v[0] for k, v in K.VENDOR_PRODUCT.items()}
_PRODUCTS = {k: v[1] for k, v in K.VENDOR_PRODUCT.items()}


def canonical_name(name: Column) -> Column:
    """Alias table first, else a slug of the name."""

    def of_key(key: Column) -> Column:
        slug = F.trim(F.regexp_replace(key, r"[^a-z0-9.+_-]+", "-"), F.lit("-"))
        return F.coalesce(lookup(K.TECHNOLOGY_ALIASES, key), blank_to_null(slug), key)

    return let(F.regexp_replace(F.lower(strip(name)), r"\s+", " "), of_key)


def clean_version(v: Column) -> Column:
    """The version text without a leading v; NULL for anything that does not look like one."""
    found = F.regexp_extract(strip(v), K.VERSION_PATTERN, 1)
    return F.when(found != "", found)


def technology(name: Column, version: Column, source: Column | str, raw: Column, vendor: Column | None = None,
               product: Column | None = None) -> Column:
    """struct(name, vendor, product, version, confidence, version_confidence, source, raw)."""
    src = F.lit(source) if isinstance(source, str) else source
    conf = {k: v[0] for k, v in K.TECHNOLOGY_CONFIDENCE.items()}
    vconf = {k: v[1] for k, v in K.TECHNOLOGY_CONFIDENCE.items()}

    def build(canon: Column, ver: Column) -> Column:
        ven, prod = lookup(_VENDORS, canon), lookup(_PRODUCTS, canon)
        return F.struct(
            canon.alias("name"),
            (ven if vendor is None else F.coalesce(ven, vendor)).alias("vendor"),
            (prod if product is None else F.coalesce(prod, product)).alias("product"),
            ver.alias("version"),
            lookup(conf, src).alias("confidence"),
            F.when(ver.isNotNull(), lookup(vconf, src)).alias("version_confidence"),
            src.alias("source"),
            raw.alias("raw"),
        )

    return let(F.struct(canonical_name(name).alias("c"), clean_version(version).alias("v")), lambda x: build(x["c"], x["v"]))


def from_fingerprint(entry: Column) -> Column:
    """'Nginx:1.24.0' or 'HSTS'."""
    version = F.when(entry.contains(":"), F.regexp_replace(entry, r"^[^:]*:", ""))
    return technology(F.substring_index(entry, ":", 1), version, "httpx-wappalyzer", entry)


def from_server_header(header: Column) -> Column:
    """'nginx/1.24.0 (Ubuntu)'; NULL when the header does not start with a product name."""
    text = strip(header)
    version = F.regexp_extract(text, K.SERVER_PATTERN, 2)
    built = technology(
        F.regexp_extract(text, K.SERVER_PATTERN, 1), F.when(version != "", version), "httpx-server-header", header
    )
    return F.when(text.rlike(K.SERVER_PATTERN), built)


def from_cpe(cpe: Column, source: str = "bbot-cpe") -> Column:
    """'cpe:/a:vendor:product[:version]' or 'cpe:2.3:a:vendor:product:version:...'; '*' and '-' mean unknown."""
    parts = F.split(cpe, ":", -1)
    n = F.size(parts)
    new = (n >= 5) & (F.get(parts, F.lit(1)) == "2.3")
    old = (n >= 4) & F.startswith(F.get(parts, F.lit(1)), F.lit("/"))
    vendor = F.when(new, F.get(parts, F.lit(3))).when(old, F.get(parts, F.lit(2)))
    product = F.when(new, F.get(parts, F.lit(4))).when(old, F.get(parts, F.lit(3)))
    version = F.when(new, F.get(parts, F.lit(5))).when(old, F.get(parts, F.lit(4)))
    version = F.when(~version.isin("*", "-", ""), version)
    built = technology(F.replace(product, F.lit("_"), F.lit(" ")), version, source, cpe, vendor, product)
    return F.when(product.isNotNull() & ~product.isin("", "*", "-"), built)


def from_name(name: Column, source: str, version: Column | None = None) -> Column:
    return technology(name, F.lit(None).cast("string") if version is None else version, source, name)


def discovered_technology(raw: Column) -> Column:
    """A passive-discovery technology value: a CPE or a bare name."""
    return F.when(F.startswith(raw, F.lit("cpe:")), from_cpe(raw)).when(raw != "", from_name(raw, "bbot"))


def merge_technologies(entries: Column) -> Column:
    """One entry per name: versioned first, then higher confidence, then the earliest; sorted by name.

    Works on the array of a single observation (a handful of fingerprints)."""
    indexed = F.transform(
        F.array_compact(entries),
        lambda t, i: F.struct(
            t["name"].alias("n"), F.when(t["version"].isNull(), 1).otherwise(0).alias("u"),
            (-t["confidence"]).alias("c"), i.alias("i"), t.alias("t"),
        ),
    )
    ordered = F.array_sort(indexed, lambda a, b: _compare(a, b))
    first = F.filter(
        F.transform(ordered, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda e: (e["i"] == 0) | (e["x"]["n"] != F.get(ordered, e["i"] - 1)["n"]),
    )
    return F.transform(first, lambda e: e["x"]["t"])


def _compare(a: Column, b: Column) -> Column:
    out = None
    for f in ("n", "u", "c", "i"):
        less, more = a[f] < b[f], a[f] > b[f]
        out = F.when(less, -1) if out is None else out.when(less, -1)
        out = out.when(more, 1)
    return out.otherwise(0)


def build_cpe(vendor: Column, product: Column, version: Column) -> Column:
    v, p, n = F.lower(vendor), F.lower(product), F.lower(version)
    ok = v.rlike(K.TOKEN_PATTERN) & p.rlike(K.TOKEN_PATTERN) & n.rlike(K.CPE_VERSION_PATTERN)
    return F.when(ok, F.concat(F.lit("cpe:2.3:a:"), v, F.lit(":"), p, F.lit(":"), n, F.lit(":*:*:*:*:*:*:*")))


def confidence_level(value: Column) -> Column:
    return F.when(value >= 0.75, "high").when(value >= 0.5, "medium").otherwise("low")


@recorded
def with_cpe_candidate(df: DataFrame, technology: str, version: str, source_cpe: str | None = None, out: str = "candidate") -> DataFrame:
    """Add ``out`` = struct(cpe, vendor, product, confidence, level), NULL without a version or a reliable mapping."""
    tech, ver = F.col(technology), F.col(version)
    src = F.col(source_cpe) if source_cpe else F.lit(None).cast("string")
    parts = F.split(src, ":", -1)
    new = F.startswith(src, F.lit("cpe:2.3:")) & (F.size(parts) >= 6)
    old = F.startswith(src, F.lit("cpe:/")) & (F.size(parts) >= 4)
    known = tech.isin(list(K.VENDOR_PRODUCT))
    vendor = F.when(known, lookup(_VENDORS, tech)).when(new, F.get(parts, F.lit(3))).when(old, F.get(parts, F.lit(2)))
    product = F.when(known, lookup(_PRODUCTS, tech)).when(new, F.get(parts, F.lit(4))).when(old, F.get(parts, F.lit(3)))
    df = opaque(
        df,
        __cpe=F.when(ver.isNotNull() & (ver != ""), build_cpe(vendor, product, ver)),
        __ven=vendor,
        __prod=product,
        __conf=F.when(known, F.lit(K.CURATED_CPE_CONFIDENCE)).otherwise(F.lit(K.SOURCE_CPE_CONFIDENCE)),
    )
    built = F.struct(
        F.col("__cpe").alias("cpe"), F.col("__ven").alias("vendor"), F.col("__prod").alias("product"),
        F.col("__conf").alias("confidence"), confidence_level(F.col("__conf")).alias("level"),
    )
    return df.withColumn(out, F.when(F.col("__cpe").isNotNull(), built)).drop("__cpe", "__ven", "__prod", "__conf")


def source_confidence(source: Column) -> Column:
    return lookup(K.SOURCE_CONFIDENCE, source, K.DEFAULT_CONFIDENCE)
