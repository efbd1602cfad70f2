"""IP addresses and networks as fixed-width bit strings.

An address is a string of 32 (v4) or 128 (v6) characters '0'/'1'; a network is the first ``prefix`` of them.
Containment is then ``startswith``, address order is string order, and longest-prefix search is an equi-join on
``substring``.  Everything here is built from native expressions.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.common import let, opaque, recorded, strip

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_GROUP = r"[0-9a-f]{1,4}"
_FULL = rf"^(?:{_GROUP}:){{7}}{_GROUP}$"
_SHORT = rf"^(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?$"
MAPPED = "0" * 80 + "1" * 16


def v4_bits(text: Column) -> Column:
    """Bits of valid dotted-quad text."""
    return F.array_join(F.transform(F.split(text, r"\."), lambda o: F.lpad(F.conv(o, 10, 2), 8, "0")), "")


def v6_bits(groups: Column) -> Column:
    """Bits of eight colon-separated hexadecimal groups."""
    return F.array_join(F.transform(F.split(groups, ":"), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")


def v4_text(bits: Column) -> Column:
    octets = F.sequence(F.lit(0), F.lit(3))
    return F.array_join(F.transform(octets, lambda i: F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 10)), ".")


def v6_text(bits: Column) -> Column:
    """Canonical lower-case form with the first longest run of two or more zero groups compressed."""
    groups = F.sequence(F.lit(0), F.lit(7))
    full = F.array_join(
        F.transform(groups, lambda i: F.lower(F.conv(F.substring(bits, i * 16 + 1, F.lit(16)), 2, 16))), ":"
    )

    def compress(s: Column) -> Column:
        longest = None
        for n in range(8, 1, -1):
            here = F.concat(F.lit(":"), s, F.lit(":")).contains(":" + "0:" * n)
            longest = F.when(here, n) if longest is None else longest.when(here, n)
        return let(longest, lambda n: F.when(n.isNull(), s).otherwise(cut(s, F.repeat(F.lit("0:"), n))))

    def cut(s: Column, run: Column) -> Column:
        framed = F.concat(F.lit(":"), s, F.lit(":"))
        at = F.call_function("locate", F.concat(F.lit(":"), run), framed)
        head = F.substring(framed, F.lit(2), at - 2)
        tail = F.substring(framed, at + F.length(run) + 1, F.lit(100))
        return F.concat(
            F.when(at > 1, head).otherwise(F.lit("")), F.lit("::"), F.substring(tail, F.lit(1), F.greatest(F.length(tail) - 1, F.lit(0)))
        )

    return let(full, compress)


def ip_text(bits: Column) -> Column:
    return F.when(F.length(bits) == 32, v4_text(bits)).when(F.length(bits) == 128, v6_text(bits))


def network_text(net_bits: Column, version: Column) -> Column:
    """CIDR text of a prefix bit string."""
    width = F.when(version == 4, F.lit(32)).otherwise(F.lit(128))
    return F.concat(ip_text(F.rpad(net_bits, width, "0")), F.lit("/"), F.length(net_bits).cast("string"))


def with_ip_bits(df: DataFrame, text: Column, out: str, *, collapse_mapped: bool = True) -> DataFrame:
    """Add ``out``: bits of the address in ``text``, NULL when it is not a valid address.

    No trimming and no brackets here.  With ``collapse_mapped`` an IPv4-mapped IPv6 address yields 32 bits.
    """
    low, six, full, raw = (f"__{out}_{n}" for n in ("low", "six", "full", "raw"))
    df = df.withColumn(low, F.lower(text))
    src = F.col(low)

    def quad_as_groups(s: Column) -> Column:  # an embedded dotted quad at the end becomes two hexadecimal groups
        quad = F.regexp_extract(s, r":([0-9.]+)$", 1)
        pair = let(
            v4_bits(quad),
            lambda b: F.concat(
                F.conv(F.substring(b, 1, 16), 2, 16), F.lit(":"), F.conv(F.substring(b, 17, 16), 2, 16)
            ),
        )
        return F.when(quad.rlike(V4_PATTERN), F.lower(F.concat(F.regexp_replace(s, r"[0-9.]+$", ""), pair)))

    df = df.withColumn(
        six, F.when(src.contains(":"), F.when(src.contains("."), quad_as_groups(src)).otherwise(src))
    )

    def expand(s: Column) -> Column:
        left, right = F.split_part(s, F.lit("::"), F.lit(1)), F.split_part(s, F.lit("::"), F.lit(2))
        given = F.size(F.filter(F.split(s, ":"), lambda g: g != ""))
        ok = ~s.contains(":::") & (F.size(F.split(s, "::", -1)) == 2) & (given <= 7) & s.rlike(_SHORT)
        zeros = F.repeat(F.lit("0:"), F.lit(8) - given)
        text = F.concat(left, F.lit(":"), zeros, right)
        return F.when(ok, F.regexp_replace(text, "^:|:$", ""))

    s = F.col(six)
    df = df.withColumn(full, F.when(s.contains("::"), expand(s)).when(s.rlike(_FULL), s))
    df = df.withColumn(
        raw,
        # most texts are names: look at one character before trying the pattern
        F.when(F.substring(src, 1, 1).between("0", "9") & src.rlike(V4_PATTERN), v4_bits(src)).when(
            F.col(full).isNotNull(), v6_bits(F.col(full))
        ),
    )
    value = F.col(raw)
    if collapse_mapped:
        value = F.when(
            (F.length(value) == 128) & F.startswith(value, F.lit(MAPPED)), F.substring(value, 97, 32)
        ).otherwise(value)
    return opaque(df, **{out: value}).drop(low, six, full, raw)


def without_brackets(raw: Column) -> Column:
    framed = F.startswith(raw, F.lit("[")) & F.endswith(raw, F.lit("]")) & (F.length(raw) >= 2)
    return F.when(framed, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


@recorded
def normalize_ips(df: DataFrame, col: str, out: str = "ip") -> DataFrame:
    """Add ``out`` = struct(value, version, bits, error): canonical address text (brackets allowed, zones refused)."""
    raw = strip(F.col(col))
    df = with_ip_bits(df, without_brackets(raw), "__bits")
    bits = F.col("__bits")
    error = F.when(F.col(col).contains("%"), "zone_identifier").when(bits.isNull(), "invalid_ip")
    return opaque(
        df,
        **{
            out: F.struct(
                F.when(error.isNull(), ip_text(bits)).alias("value"),
                F.when(error.isNull(), F.when(F.length(bits) == 32, 4).otherwise(6)).alias("version"),
                F.when(error.isNull(), bits).alias("bits"),
                error.alias("error"),
            )
        },
    ).drop("__bits")


@recorded
def normalize_cidrs(df: DataFrame, col: str, out: str = "cidr", *, strict: bool = True) -> DataFrame:
    """Add ``out`` = struct(value, version, bits, error).

    A prefix length or, for v4, a netmask or hostmask may follow the slash.  With ``strict`` host bits must be zero,
    otherwise they are masked away.  IPv4-mapped networks are refused.  Text without a slash is refused when
    strict and taken as a single address otherwise.
    """
    df = df.withColumn("__c_raw", strip(F.col(col)))
    raw = F.col("__c_raw")
    slashes = F.length(raw) - F.length(F.replace(raw, F.lit("/"), F.lit("")))
    df = df.withColumn("__c_tail", F.when(slashes == 1, F.split_part(raw, F.lit("/"), F.lit(2))))
    df = with_ip_bits(df, F.split_part(raw, F.lit("/"), F.lit(1)), "__c_addr", collapse_mapped=False)
    addr, tail = F.col("__c_addr"), F.col("__c_tail")
    width = F.length(addr)
    mask = v4_bits(tail)
    df = df.withColumn(
        "__c_plen",
        F.when(tail.rlike("^[0-9]{1,9}$"), tail.try_cast("int"))
        .when((width == 32) & tail.rlike(V4_PATTERN) & mask.rlike("^1*0*$"), F.length(F.replace(mask, F.lit("0"), F.lit(""))))
        .when((width == 32) & tail.rlike(V4_PATTERN) & mask.rlike("^0*1*$"), F.length(F.replace(mask, F.lit("1"), F.lit(""))))
        .when((slashes == 0) & F.lit(not strict), width),
    )
    plen = F.col("__c_plen")
    host = F.substring(addr, plen + 1, F.lit(128))
    error = (
        F.when((slashes == 0) & F.lit(strict), "no_prefix_length")
        .when(addr.isNull() | plen.isNull() | (plen > width), "invalid_cidr")
        .when(F.lit(strict) & host.contains("1"), "host_bits_set")
        .when((width == 128) & F.startswith(addr, F.lit(MAPPED)) & F.lit(strict), "mapped_network")
    )
    df = opaque(df, **{"__c_err": error})
    ok = F.col("__c_err").isNull()
    net = F.substring(addr, F.lit(1), plen)
    version = F.when(width == 32, 4).when(width == 128, 6)
    return opaque(
        df,
        **{
            out: F.struct(
                F.when(ok, network_text(net, version)).alias("value"),
                F.when(ok, version).alias("version"),
                F.when(ok, net).alias("bits"),
                F.col("__c_err").alias("error"),
            )
        },
    ).drop("__c_raw", "__c_tail", "__c_addr", "__c_plen", "__c_err")


def _prefixes(networks: Iterable[str]) -> str:
    out = []
    for text in networks:
        net = ipaddress.ip_network(text)
        out.append(f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen])
    return "^(?:" + "|".join(sorted(out, key=lambda b: (len(b), b))) + ")"


def is_sensitive(bits: Column) -> Column:
    """Private, loopback, link-local, reserved, multicast, unspecified or shared (100.64/10) space."""
    four = bits.rlike(_prefixes(K.SENSITIVE_V4)) & ~bits.rlike(_prefixes(K.NOT_SENSITIVE_V4))
    six = bits.rlike(_prefixes(K.SENSITIVE_V6)) & ~bits.rlike(_prefixes(K.NOT_SENSITIVE_V6))
    return F.when(F.length(bits) == 32, four).otherwise(six)


def cidr_size(net_bits: Column, version: Column) -> Column:
    """Number of addresses; a double, exact up to 2^53 and monotone beyond."""
    return F.pow(F.lit(2.0), F.when(version == 4, F.lit(32)).otherwise(F.lit(128)) - F.length(net_bits))


def with_cidr_size(df: DataFrame, net_bits: str, version: str, limit: int = K.MAX_CIDR_SIZE) -> DataFrame:
    size = cidr_size(F.col(net_bits), F.col(version))
    return df.withColumns({"addresses": size, "over_limit": size > limit})
