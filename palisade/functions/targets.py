"""Classification of free-form targets and scope values."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.addresses import ip_text, normalize_cidrs, with_ip_bits, without_brackets
from palisade.functions.common import REST, opaque, recorded, strip
from palisade.functions.names import bare_name, domain_error, registrable_domain, wildcard_error, with_ascii_name
from palisade.functions.urls import with_url_struct, with_url_text_parts

ASN_PATTERN = r"(?i)^(?:as)?([0-9]{1,10})$"


def asn_number(c: Column) -> Column:
    """1..2^32-1 from '64500' or 'AS64500'; NULL otherwise."""
    n = F.regexp_extract(strip(c), ASN_PATTERN, 1).try_cast("long")
    return F.when((n > 0) & (n < 2**32), n)


@recorded
def normalize_asns(df: DataFrame, col: str, out: str = "asn") -> DataFrame:
    raw = strip(F.col(col))
    n = asn_number(F.col(col))
    error = F.when(~raw.rlike(ASN_PATTERN), "invalid_asn").when(n.isNull(), "asn_out_of_range")
    return opaque(df, **{out: F.struct(n.alias("value"), error.alias("error"))})


@recorded
def classify(
    df: DataFrame, col: str, out: str = "t", *, idn: bool = True, suffixes: Collection[str] = K.PUBLIC_SUFFIXES
) -> DataFrame:
    """Add ``out`` = struct(kind, value, error, host, ip_version, net_bits, asn, url).

    Order: url > asn > cidr > ip > wildcard > domain.  ``host`` is the name of domain and URL targets, ``net_bits``
    the network prefix of address, CIDR and address-URL targets.  Rejected rows keep their text and get ``error``.
    """
    df = df.withColumn("__raw", strip(F.col(col)))
    raw = F.col("__raw")
    df = df.withColumn(
        "__kind",
        F.when(raw.isNull() | (raw == ""), "empty")
        .when(raw.contains("://"), "url")
        .when((F.lower(F.substring(raw, 1, 2)) == "as") & raw.rlike("(?i)^as[0-9]{1,10}$"), "asn")
        .when(raw.contains("/"), "cidr")
        .when(F.startswith(raw, F.lit("*.")), "wildcard")
        .otherwise("host"),
    )
    kind = F.col("__kind")
    df = with_url_text_parts(df, F.when(kind == "url", raw))
    # one address parse and one name parse serve every kind
    df = with_ip_bits(
        df,
        F.when(kind == "url", F.when(F.col("__u_v6") != "", F.col("__u_v6")).otherwise(F.col("__u_name")))
        .when(kind == "host", without_brackets(raw)),
        "__bits",
    )
    df = normalize_cidrs(df.withColumn("__cidr_text", F.when(kind == "cidr", raw)), "__cidr_text", "__cidr")
    name = (
        F.when(kind == "url", F.col("__u_name"))
        .when(kind == "wildcard", F.substring(raw, 3, REST))
        .when((kind == "host") & F.col("__bits").isNull(), raw)
    )
    df = df.withColumn("__name0", name)
    if idn:
        df = with_ascii_name(df, F.col("__name0"), "__name")
    else:
        df = df.withColumn("__name", F.col("__name0"))
    df = df.withColumn("__dom", bare_name(F.col("__name")))
    df = opaque(
        df,
        __domerr=F.when(F.col("__name").isNull() & F.col("__name0").isNotNull(), "invalid_idn").otherwise(
            domain_error(F.col("__name"), F.col("__dom"))
        ),
        __text=F.when(F.col("__bits").isNotNull(), ip_text(F.col("__bits"))).otherwise(F.col("__dom")),
        __asn=F.when(kind == "asn", asn_number(raw)),
    )
    df = df.withColumn(
        "__wilderr",
        F.when(kind == "wildcard", wildcard_error(raw, F.col("__dom"), F.col("__domerr"), suffixes)),
    )
    df = with_url_struct(df, "__url", F.col("__bits"), F.col("__text"), F.col("__domerr"))
    bits, url, cidr = F.col("__bits"), F.col("__url"), F.col("__cidr")
    is_ip = (kind == "host") & bits.isNotNull()
    final = (
        F.when(is_ip, F.when(F.length(bits) == 32, "ipv4").otherwise("ipv6"))
        .when(kind == "host", "domain")
        .when(kind != "empty", kind)
    )
    problem = (
        F.when(kind == "empty", "empty")
        .when(kind == "url", url["error"])
        .when(kind == "asn", F.when(F.col("__asn").isNull(), "asn_out_of_range"))
        .when(kind == "cidr", cidr["error"])
        .when(kind == "wildcard", F.col("__wilderr"))
        .when(~is_ip, F.col("__domerr"))
    )
    df = opaque(df, __k=final, __e=problem)
    ok = F.col("__e").isNull()
    net = (
        F.when(kind == "cidr", cidr["bits"])
        .when((kind == "url") & (url["host_type"] != "domain"), bits)
        .when(is_ip, bits)
    )
    canonical = (
        F.when(kind == "url", url["value"])
        .when(kind == "asn", F.concat(F.lit("AS"), F.col("__asn").cast("string")))
        .when(kind == "cidr", cidr["value"])
        .when(kind == "wildcard", F.concat(F.lit("*."), F.col("__dom")))
        .otherwise(F.col("__text"))
    )
    version = F.when(kind == "cidr", cidr["version"]).when(bits.isNotNull(), F.when(F.length(bits) == 32, 4).otherwise(6))
    host = F.when(kind == "url", F.when(url["host_type"] == "domain", url["host"])).when(
        F.col("__k") == "domain", F.col("__dom")
    )
    return opaque(
        df,
        **{
            out: F.struct(
                F.when(ok, F.col("__k")).alias("kind"),
                F.when(ok, canonical).alias("value"),
                F.col("__e").alias("error"),
                F.when(ok, host).alias("host"),
                F.when(ok & net.isNotNull(), version).alias("ip_version"),
                F.when(ok, net).alias("net_bits"),
                F.when(ok, F.col("__asn")).alias("asn"),
                F.when(ok & (kind == "url"), url).alias("url"),
            )
        },
    ).drop(
        "__raw", "__kind", "__bits", "__cidr_text", "__cidr", "__name0", "__name", "__dom", "__domerr", "__text",
        "__wilderr", "__asn", "__url", "__k", "__e",
    )


@recorded
def normalize_scope_values(df: DataFrame, type_col: str, value_col: str, out: str = "scope", *, idn: bool = True, suffixes: Collection[str] = K.PUBLIC_SUFFIXES
) -> DataFrame:
    """Add ``out`` = classification of a scope value checked against its declared type (``error`` on mismatch)."""
    declared = F.lower(strip(F.col(type_col)))
    # an ASN may be declared without its prefix
    text = F.when(
        (declared == "asn") & F.col(value_col).rlike(r"^\s*[0-9]{1,10}\s*$"), F.concat(F.lit("AS"), strip(F.col(value_col)))
    ).otherwise(strip(F.col(value_col)))
    # a wildcard may be declared in any case; the base is lowered by the name rules
    df = classify(df.withColumn("__v", text), "__v", "__c", idn=idn, suffixes=suffixes)
    c = F.col("__c")
    error = (
        F.when(~declared.isin(*K.SCOPE_TYPES) | declared.isNull(), "unsupported_type")
        .when(c["error"].isNotNull(), c["error"])
        .when(c["kind"] != declared, "type_mismatch")
    )
    fields = [c[f].alias(f) for f in ("host", "ip_version", "net_bits", "asn", "url")]
    return opaque(
        df,
        **{
            out: F.struct(
                declared.alias("type"), F.when(error.isNull(), c["value"]).alias("value"), error.alias("error"), *fields
            )
        },
    ).drop("__v", "__c")


def asset_type(kind: Column, value: Column, suffixes: Collection[str] = K.PUBLIC_SUFFIXES) -> Column:
    """A domain that is its own registrable domain is ``domain``, any other name ``subdomain``; else the kind."""
    return F.when(
        kind == "domain",
        F.when(registrable_domain(value, suffixes).eqNullSafe(value), "domain").otherwise("subdomain"),
    ).otherwise(kind)

