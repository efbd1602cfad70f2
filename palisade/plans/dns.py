"""DNS record sets, one row per (name, run, record)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.addresses import ip_text, with_ip_bits
from palisade.functions.common import lookup, opaque
from palisade.functions.names import bare_name, domain_error
from palisade.functions.targets import asset_type
from palisade.operators.enrich import dns_enrichment, enrich_ips, lookup_asn
from palisade.plans.base import Observed, Stage, as_is, asset_rows, edge_rows, union

TYPES = ("A", "AAAA", "CNAME", "MX", "NS", "TXT")


def dns_plan(answers: DataFrame, cloud_ranges: DataFrame, asn_ranges: DataFrame, stage: Stage = as_is) -> Observed:
    """answers: (name, run, observed_at, seq, record_type, value, nxdomain); a row without value says that the type was
    asked.  Edges per record type, enrichment of A/AAAA answers, one state per (name, run).

    NXDOMAIN is reported only when every asked type said so and nothing was answered."""
    is_address = F.col("record_type").isin("A", "AAAA")
    rows = with_ip_bits(answers, F.when(is_address, F.col("value")), "ip_bits")
    # names may come with a trailing dot
    rows = rows.withColumn("__name", bare_name(F.when(~F.col("record_type").isin("A", "AAAA", "TXT"), F.col("value"))))
    good_name = domain_error(F.col("__name"), F.col("__name")).isNull()
    rows = opaque(
        rows, target=F.when(F.col("ip_bits").isNotNull(), ip_text(F.col("ip_bits"))).when(F.col("__name").isNotNull() & good_name, F.col("__name"))
    ).drop("__name")
    rows = stage(rows)
    linked = rows.filter(F.col("target").isNotNull())
    rel = lookup(K.DNS_EDGES, F.col("record_type"))
    kind = F.when(F.length("ip_bits") == 32, "ipv4").when(F.length("ip_bits") == 128, "ipv6").otherwise(asset_type(F.lit("domain"), F.col("target")))
    reason = F.concat("record_type", F.lit(" record of "), "name")
    if stage is as_is:
        # nothing is written, so every output parses the answers again: what needs no names goes without them
        asked, resolved = answers, with_ip_bits(answers.filter(is_address), F.col("value"), "ip_bits").filter(F.col("ip_bits").isNotNull())
    else:
        asked, resolved = rows, rows.filter(F.col("ip_bits").isNotNull())
    addressed = enrich_ips(linked.filter(F.col("ip_bits").isNotNull()), cloud_ranges, asn_ranges, "ip_bits", resolved)
    # edges and assets take the AS alone, one per address
    numbers = lookup_asn(resolved, asn_ranges, "ip_bits").filter(F.col("asn").isNotNull()).select("ip_bits", "asn")
    with_asn = resolved.join(numbers, "ip_bits")
    as_name = F.concat(F.lit("AS"), F.col("asn").cast("string"))
    assets = union(
        asset_rows(rows, asset_type(F.lit("domain"), F.col("name")), F.col("name"), "dns", "resolved by DNS worker"),
        asset_rows(linked, kind, F.col("target"), "dns", reason),
        asset_rows(with_asn, "asn", as_name, "ipranges", "routing data"),
    )
    edges = union(
        edge_rows(linked, F.col("name"), F.col("target"), rel, "dns", 0.95, F.to_json(F.struct("record_type"))),
        edge_rows(with_asn, ip_text(F.col("ip_bits")), as_name, "BELONGS_TO_ASN", "iptoasn", 0.9),
    )
    # one resolver answer per (name, run): a handful of records
    values = [
        F.array_sort(F.collect_set(F.when(F.col("record_type") == t, F.col("value")))).alias(t.lower()) for t in TYPES
    ]
    answered = asked.groupBy("name", "run").agg(
        *values, F.max("observed_at").alias("observed_at"), F.max("seq").alias("seq"),
        (F.every(F.coalesce("nxdomain", F.lit(False))) & (F.count("value") == 0)).alias("__nx"),
    )
    sets = dns_enrichment(resolved, cloud_ranges, asn_ranges, ["name", "run"])
    both = answered.join(sets, ["name", "run"], "left")
    empty = F.array().cast("array<string>")
    state = F.struct(
        *[t.lower() for t in TYPES], F.coalesce(F.col("asns").cast("array<string>"), empty).alias("asn"),
        F.coalesce("providers", empty).alias("cloud"), F.lit(True).alias("has_asn"), F.lit(True).alias("has_cloud"),
    )
    states = both.select(
        F.col("name").alias("asset_id"), F.lit("dns").alias("facet"), "observed_at", "seq", state.alias("current"), "run",
        F.when(F.col("__nx"), "NXDOMAIN").otherwise("NOERROR").alias("status"),
    )
    return Observed(rows, assets, edges, states, {"addresses": addressed})
