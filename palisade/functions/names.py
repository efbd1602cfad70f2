"""Host names: strict normalisation, wildcards, public suffixes."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import constants as K
from palisade.functions.common import REST, opaque, recorded, strip

FORBIDDEN = r"(?U)[\s\\\x00-\x1f\x7f]"
_LABEL = r"[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?"
_TLD = r"(?:[a-z]{2,63}|xn--[a-z0-9-]{0,58}[a-z0-9])"


def _label_encoder():
    """Arrow UDF giving the ASCII form of names with non-ASCII labels; NULL when a label cannot be encoded.  Without the idna
    module the first such name is an error.  Made on demand and self-contained, so executors need not have this package installed."""

    def encode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def encode(name):
            if name is None:
                return None
            import idna

            out = []
            for label in name.split("."):
                if label and not label.isascii():
                    try:
                        label = idna.encode(label, uts46=True).decode("ascii")
                    except idna.IDNAError:
                        return None
                    if "." in label:
                        return None
                out.append(label)
            return ".".join(out)

        for batch in batches:
            yield batch.map(encode, na_action="ignore").astype(object)

    return F.pandas_udf(encode_batches, T.StringType())


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7f]*$")


def with_ascii_name(df: DataFrame, name: Column, out: str) -> DataFrame:
    """Punycode form of international names.  Only they reach Python: ASCII rows pass NULL through the UDF."""
    df = df.withColumn("__n_src", name)
    df = df.withColumn("__n_enc", _label_encoder()(F.when(~is_ascii(F.col("__n_src")), F.col("__n_src"))))
    value = F.when(is_ascii(F.col("__n_src")), F.col("__n_src")).otherwise(F.col("__n_enc"))
    return df.withColumn(out, value).drop("__n_src", "__n_enc")


def bare_name(raw: Column) -> Column:
    """Lower case without one trailing dot."""
    cut = F.substring(raw, F.lit(1), F.length(raw) - 1)
    return F.lower(F.when(F.endswith(raw, F.lit(".")), cut).otherwise(raw))


def domain_error(raw: Column, name: Column) -> Column:
    """Why ``name`` (= ``bare_name(raw)``) is not a host name; NULL when it is.  Most names pass the first test."""
    good = name.rlike(rf"^(?:{_LABEL}\.)+{_TLD}$") & (F.length(name) <= 253)
    return F.when(~F.coalesce(good, F.lit(False)), (
        F.when(raw.isNull() | (raw == ""), "empty")
        .when(raw.rlike(FORBIDDEN), "forbidden_characters")
        .when(raw.rlike(r"[*/:@]"), "invalid_characters")
        .when(name.rlike(r"^$|^\.|\.\.|\.$"), "empty_label")
        .when(~is_ascii(name), "invalid_idn")
        .when(~name.contains("."), "too_few_labels")
        .when(~name.rlike(rf"^(?:{_LABEL}\.)+{_LABEL}$"), "invalid_label")
        .when(~name.rlike(rf"\.{_TLD}$"), "invalid_top_level")
        .otherwise("too_long")
    ))


@recorded
def normalize_domains(df: DataFrame, col: str, out: str = "domain", *, idn: bool = True) -> DataFrame:
    """Add ``out`` = struct(value, error): lower-case ASCII name without trailing dot.

    International names get their ASCII form by one Arrow UDF; with ``idn=False`` they are rejected and no Python runs.
    """
    if idn:
        df = with_ascii_name(df, strip(F.col(col)), "__d_raw")
    else:
        df = df.withColumn("__d_raw", strip(F.col(col)))
    df = df.withColumn("__d_name", bare_name(F.col("__d_raw")))
    error = domain_error(F.col("__d_raw"), F.col("__d_name"))
    if idn:
        error = F.when(F.col("__d_raw").isNull() & F.col(col).isNotNull(), "invalid_idn").otherwise(error)
    df = opaque(df, __d_err=error)
    value = F.when(F.col("__d_err").isNull(), F.col("__d_name"))
    return df.withColumn(out, F.struct(value.alias("value"), F.col("__d_err").alias("error"))).drop(
        "__d_raw", "__d_name", "__d_err"
    )


def label_count(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def host_suffixes(name: Column) -> Column:
    """The name and each of its parent names, longest first."""
    return F.transform(
        F.sequence(label_count(name), F.lit(1), F.lit(-1)),
        lambda k: F.call_function("substring_index", name, F.lit("."), -k),
    )


def _suffix_length(name: Column, suffixes: Collection[str]) -> Column:
    """Number of labels of the public suffix of a name; NULL when none is known."""
    plain = [s for s in suffixes if s[0] not in "*!"]
    under = [s[2:] for s in suffixes if s.startswith("*.")]
    exceptions = [s[1:] for s in suffixes if s.startswith("!")]
    n = label_count(name)
    deepest = max((s.count(".") + 1 for s in suffixes), default=1)
    out = None

    def branch(cond: Column, value: Column) -> None:
        nonlocal out
        out = F.when(cond, value) if out is None else out.when(cond, value)

    for k in range(deepest, 0, -1):
        tail = F.substring_index(name, ".", -k)
        if exceptions:
            branch((n >= k) & tail.isin(exceptions), F.lit(k - 1))
    for k in range(deepest, 0, -1):
        tail = F.substring_index(name, ".", -k)
        if under and k > 1:
            branch((n >= k) & F.substring_index(name, ".", -(k - 1)).isin(under), F.lit(k))
        branch((n >= k) & tail.isin(plain), F.lit(k))
    return out


def is_public_suffix(name: Column, suffixes: Collection[str] = K.PUBLIC_SUFFIXES) -> Column:
    return F.coalesce(_suffix_length(name, suffixes) == label_count(name), F.lit(False))


def may_be_public_suffix(name: Column, suffixes: Collection[str] = K.PUBLIC_SUFFIXES) -> Column:
    """Whether a wildcard over the name has to be refused: it is a public suffix, or it may be one that the list lacks.

    That is a single label no entry covers, and a label below a country's two letters that no entry covers or that stands for a kind of registrant."""
    size, n = _suffix_length(name, suffixes), label_count(name)
    country = (n == 2) & (F.length(F.substring_index(name, ".", -1)) == 2)
    kind = F.substring_index(name, ".", 1).isin(list(K.REGISTRANT_LABELS))
    return F.coalesce(size == n, F.lit(False)) | (size.isNull() & ((n == 1) | country)) | (country & kind)


def registrable_domain(name: Column, suffixes: Collection[str] = K.PUBLIC_SUFFIXES) -> Column:
    """Public suffix plus one label; NULL for a public suffix itself, the last label when no suffix is known."""
    size = _suffix_length(name, suffixes)
    return (
        F.when(size.isNull(), F.substring_index(name, ".", -1))
        .when(size == label_count(name), F.lit(None).cast("string"))
        .otherwise(F.call_function("substring_index", name, F.lit("."), -(size + 1)))
    )


def wildcard_error(raw: Column, base: Column, base_error: Column, suffixes: Collection[str]) -> Column:
    """``raw`` is the trimmed text, ``base``/``base_error`` the normalised name after ``*.``."""
    return (
        F.when(~F.startswith(raw, F.lit("*.")), "not_a_wildcard")
        .when(F.substring(raw, 3, REST).contains("*"), "nested_wildcard")
        .when(base_error.isNotNull(), base_error)
        .when(may_be_public_suffix(base, suffixes), "public_suffix")
    )


@recorded
def normalize_wildcards(
    df: DataFrame, col: str, out: str = "wildcard", *, suffixes: Collection[str] = K.PUBLIC_SUFFIXES, idn: bool = True
) -> DataFrame:
    """Add ``out`` = struct(value, error): ``*.`` plus a normalised name that is not a public suffix."""
    df = df.withColumn("__w_raw", strip(F.col(col)))
    base = F.when(F.startswith(F.col("__w_raw"), F.lit("*.")), F.substring(F.col("__w_raw"), 3, REST))
    df = normalize_domains(df.withColumn("__w_base", base), "__w_base", "__w", idn=idn)
    error = wildcard_error(F.col("__w_raw"), F.col("__w.value"), F.col("__w.error"), suffixes)
    df = opaque(df, __w_err=error)
    value = F.when(F.col("__w_err").isNull(), F.concat(F.lit("*."), F.col("__w.value")))
    return df.withColumn(out, F.struct(value.alias("value"), F.col("__w_err").alias("error"))).drop(
        "__w_raw", "__w_base", "__w", "__w_err"
    )


def name_flags(name: Column) -> Column:
    """Heuristic flags of one normalised name: suspicious_tld, numeric (a label before the last starts with a digit), punycode."""
    base = F.regexp_replace(name, r"^\*\.", "")
    return F.array_compact(
        F.array(
            F.when(base.rlike(r"(?:^|\.)[0-9][^.]*\."), "numeric"),
            F.when(base.rlike(r"(?:^|\.)xn--"), "punycode"),
            F.when(F.substring_index(base, ".", -1).isin(list(K.SUSPICIOUS_TLDS)), "suspicious_tld"),
        )
    )


def certificate_flags(names: Column) -> Column:
    """Sorted union of the flags of every name on a certificate."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(names, name_flags))))
