"""Certificate-transparency messages."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import schemas as S
from palisade.functions.common import REST, blank_to_null, opaque, strip
from palisade.functions.names import bare_name, certificate_flags, domain_error, may_be_public_suffix
from palisade import constants as K


def _hex(c: Column) -> Column:
    return blank_to_null(F.lower(F.replace(c, F.lit(":"), F.lit(""))))


def _instant(c: Column) -> Column:
    return F.when(c > 0, F.timestamp_seconds(c))


def parse_ct(messages: DataFrame, col: str = "value", suffixes: Collection[str] = K.PUBLIC_SUFFIXES) -> DataFrame:
    """One row per certificate update: fingerprint (SHA-256, else ``sha1:``), sorted names, wildcards, rejects, flags.

    Both server formats are read; other messages and certificates without a fingerprint are dropped."""
    df = opaque(messages, __m=F.from_json(col, S.CT_MESSAGE)).filter(F.col("__m.message_type") == "certificate_update")
    data = F.col("__m.data")
    leaf = data["leaf_cert"]
    text_names = F.transform(
        F.filter(F.split(leaf["extensions"]["subjectAltName"], ",", -1), lambda p: F.startswith(F.trim(p), F.lit("DNS:"))),
        lambda p: F.substring(F.trim(p), 5, REST),
    )
    empty = F.array().cast("array<string>")
    names = F.array_distinct(F.array_compact(F.concat(
        F.coalesce(leaf["all_domains"], empty), F.array(blank_to_null(leaf["subject"]["CN"])), F.coalesce(text_names, empty)
    )))
    df = opaque(df, __sha1=F.coalesce(_hex(leaf["sha1"]), _hex(leaf["fingerprint"])), __sha256=_hex(leaf["sha256"]), __names=names)
    df = df.filter(F.coalesce("__sha256", "__sha1").isNotNull())

    def judged(n: Column) -> Column:
        wild = F.startswith(n, F.lit("*."))
        raw = F.when(wild, F.substring(strip(n), 3, REST)).otherwise(strip(n))
        name = bare_name(raw)
        bad = domain_error(raw, name).isNotNull() | (wild & may_be_public_suffix(name, suffixes))
        return F.struct(n.alias("raw"), wild.alias("wild"), F.when(~bad, name).alias("name"))

    df = opaque(df, __judged=F.transform("__names", judged))
    pick = lambda cond, value: F.array_sort(F.array_distinct(F.transform(F.filter("__judged", cond), value)))
    df = opaque(
        df,
        __domains=pick(lambda x: x["name"].isNotNull() & ~x["wild"], lambda x: x["name"]),
        __wildcards=pick(lambda x: x["name"].isNotNull() & x["wild"], lambda x: F.concat(F.lit("*."), x["name"])),
        __invalid=pick(lambda x: x["name"].isNull(), lambda x: x["raw"]),
    )
    keep = [c for c in messages.columns if c != col]
    return df.select(
        *keep,
        F.coalesce(F.col("__sha256"), F.concat(F.lit("sha1:"), F.col("__sha1"))).alias("fingerprint"),
        F.col("__sha1").alias("sha1"), F.col("__sha256").alias("sha256"), leaf["serial_number"].alias("serial"),
        leaf["subject"]["CN"].alias("subject_cn"), leaf["subject"]["aggregated"].alias("subject_dn"),
        leaf["issuer"]["CN"].alias("issuer_cn"), leaf["issuer"]["O"].alias("issuer_o"),
        leaf["issuer"]["aggregated"].alias("issuer_dn"), _instant(leaf["not_before"]).alias("not_before"),
        _instant(leaf["not_after"]).alias("not_after"), F.col("__domains").alias("domains"),
        F.col("__wildcards").alias("wildcards"), F.col("__invalid").alias("invalid_names"),
        certificate_flags(F.concat("__domains", "__wildcards")).alias("flags"), _instant(data["seen"]).alias("seen"),
        data["source"]["url"].alias("source_url"), data["source"]["name"].alias("source_name"),
        data["cert_index"].alias("cert_index"), data["update_type"].alias("update_type"),
    )
