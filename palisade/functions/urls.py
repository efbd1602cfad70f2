"""URL normalisation from native expressions.

``parse_url`` is deliberately not used: it rejects hosts with ``_``, keeps case and drops bad escapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.addresses import ip_text, with_ip_bits
from palisade.functions.common import REST, opaque, recorded, sha256, strip
from palisade.functions.names import FORBIDDEN, bare_name, domain_error, with_ascii_name

_BARE_PATH = r"^[A-Za-z0-9/:@!$&'()*+,;=\-._~]*$"
_BARE_QUERY = r"^[A-Za-z0-9_.\-~]*$"
# characters that stay literal in a path: what form encoding makes of them -> the character
_PATH_SAFE = {
    "%2F": "/", "%3A": ":", "%40": "@", "%21": "!", "%24": "$", "%26": "&", "%27": "'", "%28": "(", "%29": ")",
    "%2B": "+", "%2C": ",", "%3B": ";", "%3D": "=", "%7E": "~",
}


def _decode(c: Column) -> Column:
    """Percent-decode; a '%' that starts no valid escape stays as it is, '+' becomes a space."""
    return F.when(~(c.contains("%") | c.contains("+")), c).otherwise(F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")))


def decode_path(path: Column) -> Column:
    return F.when(path.contains("%"), _decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)


def encode_path(path: Column) -> Column:
    out = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for code, char in _PATH_SAFE.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.when(path.rlike(_BARE_PATH), path).otherwise(out)


def encode_query_part(c: Column) -> Column:
    coded = F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(c.rlike(_BARE_QUERY), c).otherwise(coded)


def resolve_dots(decoded: Column) -> Column:
    """Absolute path without empty, '.' and '..' segments; a trailing slash is kept."""
    stack = F.aggregate(
        F.split(decoded, "/", -1),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.concat(F.lit("/"), F.array_join(stack, "/"))
    kept = F.when(F.endswith(decoded, F.lit("/")) & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    plain = F.startswith(decoded, F.lit("/")) & ~decoded.contains("//") & ~decoded.contains("/.")
    return F.when(decoded == "", F.lit("/")).when(plain, decoded).otherwise(kept)


def query_pairs(query: Column) -> Column:
    """Decoded (name, value) pairs sorted by name, then value; blank values are kept."""
    pieces = F.filter(F.split(F.coalesce(query, F.lit("")), "&", -1), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            F.coalesce(_decode(F.substring_index(p, "=", 1)), F.lit("")).alias("k"),
            F.when(p.contains("="), F.coalesce(_decode(F.regexp_replace(p, "^[^=]*=", "")), F.lit(""))).otherwise(F.lit("")).alias("v"),
        ),
    )
    return F.array_sort(pairs)


def with_url_text_parts(df: DataFrame, url: Column, prefix: str = "__u") -> DataFrame:
    """First stage: scheme, netloc, path and query text and the host before it is normalised."""
    p, rest = prefix, REST
    df = df.withColumn(f"{p}_raw", url)
    df = df.withColumn(f"{p}_nofrag", F.substring_index(F.col(f"{p}_raw"), "#", 1))
    whole = F.col(f"{p}_nofrag")
    df = df.withColumn(f"{p}_noquery", F.substring_index(whole, "?", 1))
    head = F.col(f"{p}_noquery")
    df = df.withColumns(
        {
            f"{p}_query": F.substring(whole, F.length(head) + 2, F.lit(rest)),
            f"{p}_scheme": F.when(head.contains("://"), F.lower(F.substring_index(head, "://", 1))),
        }
    )
    after = F.substring(head, F.length(F.col(f"{p}_scheme")) + 4, F.lit(rest))
    df = df.withColumn(f"{p}_after", after)
    df = df.withColumn(f"{p}_netloc", F.substring_index(F.col(f"{p}_after"), "/", 1))
    netloc = F.col(f"{p}_netloc")
    framed = F.startswith(netloc, F.lit("["))
    df = df.withColumns(
        {
            f"{p}_path": F.substring(F.col(f"{p}_after"), F.length(netloc) + 1, F.lit(rest)),
            f"{p}_v6": F.when(framed, F.substring_index(F.substring(netloc, 2, rest), "]", 1)).otherwise(F.lit("")),
            f"{p}_name": F.when(framed, F.lit("")).otherwise(F.lower(F.substring_index(netloc, ":", 1))),
        }
    )
    tail = F.when(framed, F.substring(netloc, F.length(F.col(f"{p}_v6")) + 3, F.lit(rest))).otherwise(
        F.substring(netloc, F.length(F.col(f"{p}_name")) + 1, F.lit(rest))
    )
    return df.withColumn(f"{p}_tail", tail)  # '' or ':port'


def with_url_struct(
    df: DataFrame, out: str, host_bits: Column, host_text: Column, domain_problem: Column, prefix: str = "__u"
) -> DataFrame:
    """Last stage: validate, normalise path and query, hash.  The arguments describe the URL host:
    bits when it is an address, its canonical text, and what is wrong with it as a name."""
    p = prefix
    raw, scheme, netloc = F.col(f"{p}_raw"), F.col(f"{p}_scheme"), F.col(f"{p}_netloc")
    v6, name, tail = F.col(f"{p}_v6"), F.col(f"{p}_name"), F.col(f"{p}_tail")
    port = F.when(tail.rlike("^:[0-9]{1,9}$"), F.substring(tail, 2, 9).try_cast("int"))
    port_ok = tail.isin("", ":") | F.coalesce(port.between(1, 65535), F.lit(False))
    error = (
        F.when(raw.isNull() | (raw == ""), "empty")
        .when(raw.rlike(FORBIDDEN), "forbidden_characters")
        .when(scheme.isNull(), "no_scheme_or_host")
        .when(~scheme.isin(*K.DEFAULT_PORTS), "unsupported_scheme")
        .when(netloc.contains("@"), "userinfo")
        .when(name.contains("[") | name.contains("]"), "invalid_host")
        .when(F.startswith(netloc, F.lit("[")) & ~netloc.contains("]"), "invalid_host")
        .when((v6 == "") & (name == ""), "no_host")
        .when((v6 != "") & ~v6.contains(":"), "invalid_host")
        .when(~port_ok, "invalid_port")
        .when(host_bits.isNull() & domain_problem.isNotNull(), domain_problem)
        .when(F.col(f"{p}_path").contains("%00"), "nul_in_path")
    )
    df = df.withColumns(
        {
            f"{p}_err": error,
            f"{p}_host": host_text,
            f"{p}_type": F.when(F.length(host_bits) == 32, "ipv4").when(F.length(host_bits) == 128, "ipv6").otherwise("domain"),
            f"{p}_dec": decode_path(F.col(f"{p}_path")),
            f"{p}_pairs": F.when(F.col(f"{p}_query") != "", query_pairs(F.col(f"{p}_query"))),
            f"{p}_num": F.when(F.length(tail) > 1, port),
        }
    )
    host, pairs = F.col(f"{p}_host"), F.col(f"{p}_pairs")
    default = F.when(scheme == "http", 80).otherwise(443)
    shown = F.when(F.col(f"{p}_type") == "ipv6", F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    query = F.array_join(
        F.transform(pairs, lambda x: F.concat(encode_query_part(x.k), F.lit("="), encode_query_part(x.v))), "&"
    )
    df = opaque(
        df,
        **{
            f"{p}_ok": F.col(f"{p}_err").isNull(),
            f"{p}_e": F.col(f"{p}_err"),
            f"{p}_h": host,
            f"{p}_ht": F.col(f"{p}_type"),
            f"{p}_pt": F.coalesce(F.col(f"{p}_num"), default),
            f"{p}_origin": F.concat(
                scheme, F.lit("://"), shown,
                F.when(F.coalesce(F.col(f"{p}_num"), default) == default, F.lit("")).otherwise(
                    F.concat(F.lit(":"), F.col(f"{p}_num").cast("string"))
                ),
            ),
            f"{p}_np": encode_path(resolve_dots(F.col(f"{p}_dec"))),
            f"{p}_nq": F.coalesce(query, F.lit("")),
            f"{p}_params": F.coalesce(F.array_distinct(F.transform(pairs, lambda x: x.k)), F.array().cast("array<string>")),
        },
    )
    ok, origin = F.col(f"{p}_ok"), F.col(f"{p}_origin")
    path, q, params = F.col(f"{p}_np"), F.col(f"{p}_nq"), F.col(f"{p}_params")
    df = df.withColumn(
        f"{p}_full", F.concat(origin, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    )
    full = F.col(f"{p}_full")
    when = lambda c: F.when(ok, c)
    df = opaque(
        df,
        **{
            out: F.struct(
                when(full).alias("value"),
                F.col(f"{p}_e").alias("error"),
                when(scheme).alias("scheme"),
                when(F.col(f"{p}_h")).alias("host"),
                when(F.col(f"{p}_ht")).alias("host_type"),
                when(F.col(f"{p}_pt")).alias("port"),
                when(path).alias("path"),
                when(q).alias("query"),
                when(sha256(full)).alias("url_hash"),
                when(path).alias("endpoint"),
                when(sha256(F.concat(origin, path, F.lit("|"), F.array_join(params, ",")))).alias("endpoint_hash"),
                when(params).alias("parameters"),
                when(origin).alias("origin"),
            )
        },
    )
    parts = (
        "raw nofrag noquery query scheme after netloc path v6 name tail err host type dec pairs num ok e h ht pt origin np nq params full "
        "bits ascii dom text domerr"
    )
    return df.drop(*[f"{p}_{x}" for x in parts.split()])


@recorded
def normalize_urls(df: DataFrame, col: str, out: str = "u", *, idn: bool = True) -> DataFrame:
    """Add ``out`` = struct(value, error, scheme, host, host_type, port, path, query, url_hash, endpoint,
    endpoint_hash, parameters, origin).  Only http(s); no userinfo; default port, dot segments and fragment go;
    the query is sorted."""
    df = with_url_text_parts(df, strip(F.col(col)))
    df = with_ip_bits(df, F.when(F.col("__u_v6") != "", F.col("__u_v6")).otherwise(F.col("__u_name")), "__u_bits")
    if idn:
        df = with_ascii_name(df, F.col("__u_name"), "__u_ascii")
    else:
        df = df.withColumn("__u_ascii", F.col("__u_name"))
    df = df.withColumn("__u_dom", bare_name(F.col("__u_ascii")))
    problem = F.when(F.col("__u_name").isNotNull() & F.col("__u_ascii").isNull(), "invalid_idn").otherwise(
        domain_error(F.col("__u_ascii"), F.col("__u_dom"))
    )
    bits = F.col("__u_bits")
    df = df.withColumns(
        {"__u_text": F.when(bits.isNotNull(), ip_text(bits)).otherwise(F.col("__u_dom")), "__u_domerr": problem}
    )
    return with_url_struct(df, out, bits, F.col("__u_text"), F.col("__u_domerr"))


def endpoint_text(u: Column) -> Column:
    """Path with the sorted parameter names, values left out."""
    names = F.array_join(u["parameters"], "&")
    return F.concat(u["endpoint"], F.when(names != "", F.concat(F.lit("?"), names)).otherwise(F.lit("")))


def is_script_link(tag: Column, source: Column) -> Column:
    """Found by or in a script: script-parser tags, or the linking page is a .js file."""
    by_tag = F.lower(F.coalesce(tag, F.lit(""))).isin("js", "jsluice")
    by_page = F.endswith(F.substring_index(F.coalesce(source, F.lit("")), "?", 1), F.lit(".js"))
    return by_tag | by_page
