"""Attribution of addresses to provider ranges and autonomous systems.

Both lookups are longest-prefix equi-joins over distinct addresses.  A range table is first cut into prefix blocks, so
no range condition ever reaches the planner as a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade import constants as K
from palisade.functions.values import content_id
from palisade.operators.skew import BROADCAST_BYTES, first_per_key, lookup_join, with_next


#: Of a broadcast block: its bits as text and its attributes.
BLOCK_BYTES = 400
#: Prefix lengths up to which every length is a join of its own.
LOOKS = 12


def _profile(blocks: DataFrame, length: Column) -> tuple[list[int], int]:
    """Distinct prefix lengths, at most 129 numbers whatever the table's size (32 and 128 bits share them), and the bytes of the blocks, counted:
    the optimizer's estimate of joined inputs is far too high."""
    found = blocks.groupBy(length.alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
    return sorted(r["n"] for r in found), sum(r["rows"] for r in found) * BLOCK_BYTES


def longest_prefix(ips: DataFrame, blocks: DataFrame, values: list[str], bits: str = "ip_bits") -> DataFrame:
    """(bits, values...) for every distinct address covered by a block; the longest block wins.

    ``blocks``: (ip_version, net_bits, values...) with unique (ip_version, net_bits).

    Where the blocks are broadcast and have few lengths, addresses stream past them once per length, so that no task holds or sorts its hits."""
    lengths, size = _profile(blocks, F.length("net_bits"))
    addr = F.col(bits)
    distinct = ips.select(bits).filter(addr.isNotNull()).distinct()
    version = F.when(F.length(addr) == 32, 4).otherwise(6).alias("ip_version")
    if size <= BROADCAST_BYTES and len(lengths) <= LOOKS:
        # the same table in every join, so that it is broadcast once
        table = blocks.select("ip_version", "net_bits", F.struct(F.length("net_bits").alias("prefix_len"), *values).alias("__hit"))
        found = distinct.select(bits, version, F.lit(None).cast(table.schema["__hit"].dataType).alias("__best"))
        for n in lengths:
            probed = found.withColumn("net_bits", F.when(F.length(addr) >= n, F.substring(addr, 1, n)))
            hits = probed.join(F.broadcast(table), ["ip_version", "net_bits"], "left")
            found = hits.select(bits, "ip_version", F.coalesce("__hit", "__best").alias("__best"))
        return found.filter(F.col("__best").isNotNull()).select(bits, "__best.*")
    in_use = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(addr))
    probes = distinct.select(bits, version, F.explode(F.transform(in_use, lambda n: F.substring(addr, F.lit(1), n))).alias("net_bits"))
    hits = lookup_join(
        probes, blocks.select("ip_version", "net_bits", *values), ["ip_version", "net_bits"], "inner", spread=[bits], size=size
    )
    best = F.max_by(F.struct("net_bits", *values), F.length("net_bits")).alias("__best")
    return hits.groupBy(bits).agg(best).select(bits, F.length("__best.net_bits").alias("prefix_len"), *[f"__best.{v}" for v in values])


def live_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges not removed, one per network: when two providers publish the same one, the smaller name wins."""
    live = ranges.filter(F.col("removed_at").isNull()) if "removed_at" in ranges.columns else ranges
    cols = ["ip_version", "net_bits", "provider", "organization", "category", "cidr"]
    return first_per_key(live.select(*cols), ["ip_version", "net_bits"], [F.col("provider"), F.col("cidr")])


def attribute_cloud(ips: DataFrame, ranges: DataFrame, bits: str = "ip_bits") -> DataFrame:
    """(bits, prefix_len, provider, organization, category, cidr) of the most specific live provider range."""
    return longest_prefix(ips, live_ranges(ranges), ["provider", "organization", "category", "cidr"], bits)


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two bit strings of equal length."""
    n = F.length(a)
    differs = F.filter(
        F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))
    )
    return F.coalesce(F.get(differs, F.lit(0)) - 1, n)


STRIDE = 4


def effective_ranges(ranges: DataFrame) -> DataFrame:
    """AS ranges made disjoint: one per start (the longest, then the smallest number), each cut where the next one starts.

    This gives as-of semantics: an address belongs to the range with the nearest start at or below it, and to none if that
    range has ended - a wider earlier range is not used."""
    unique = ranges.groupBy("ip_version", "start_bits").agg(
        F.max_by(F.struct("end_bits", "asn", "country", "organization"), F.struct("end_bits", -F.col("asn"))).alias("r")
    ).select("ip_version", "start_bits", "r.*")
    follow = with_next(unique, ["ip_version"], ["start_bits"], "start_bits", F.substring("start_bits", 1, 16), "next_start")
    nxt = F.col("next_start")
    # last address before the next start: its last '1' cleared, ones after it
    ones = F.length(F.rtrim(nxt, F.lit("0")))
    before = F.concat(F.substring(nxt, F.lit(1), ones - 1), F.lit("0"), F.repeat(F.lit("1"), F.length(nxt) - ones))
    cut = F.when(nxt.isNotNull() & (F.col("end_bits") >= nxt), before).otherwise(F.col("end_bits"))
    return follow.withColumn("end_bits", cut).drop("next_start")


def lookup_asn(ips: DataFrame, ranges: DataFrame, bits: str = "ip_bits") -> DataFrame:
    """(bits, asn, country, organization) of every distinct address inside an AS range.

    A range is filed under the common prefix of its first and last address, shortened to a multiple of four bits; an
    address looks under each such prefix of its own.  As the ranges are disjoint, those filed under one prefix either
    cross one of its 15 inner boundaries or are single sixteenths: at most 31 candidates per look, and at most one hit."""
    disjoint = effective_ranges(ranges)
    common = _common_prefix(F.col("start_bits"), F.col("end_bits"))
    filed = disjoint.withColumn("__n", (F.floor(common / F.lit(STRIDE)) * STRIDE).cast("int"))
    lengths, size = _profile(filed, F.col("__n"))
    filed = filed.select(
        "ip_version", F.substring(F.col("start_bits"), F.lit(1), F.col("__n")).alias("__key"), "start_bits", "end_bits", "asn", "country", "organization"
    )
    addr = F.col(bits)
    distinct = ips.select(bits).filter(addr.isNotNull()).distinct()
    in_use = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(addr))
    probes = distinct.select(
        bits, F.when(F.length(addr) == 32, 4).otherwise(6).alias("ip_version"), F.explode(F.transform(in_use, lambda n: F.substring(addr, F.lit(1), n))).alias("__key")
    )
    hits = lookup_join(probes, filed, ["ip_version", "__key"], "inner", spread=[bits], size=size)
    return hits.filter((addr >= F.col("start_bits")) & (addr <= F.col("end_bits"))).select(bits, "asn", "country", "organization")


def enrich_ips(
    rows: DataFrame, cloud_ranges: DataFrame, asn_ranges: DataFrame, bits: str, addresses: DataFrame | None = None
) -> DataFrame:
    """Left-join provider and AS to rows; each distinct address is looked up once.

    ``addresses`` may name a cheaper table with (at least) the same addresses, when ``rows`` is costly to compute."""
    source = rows if addresses is None else addresses
    cloud = attribute_cloud(source, cloud_ranges, bits).select(
        bits, F.struct("provider", "organization", "category", "cidr").alias("cloud")
    )
    asn = lookup_asn(source, asn_ranges, bits).select(
        bits, F.struct(F.col("asn").alias("number"), "organization", "country").alias("asn")
    )
    return rows.join(cloud, bits, "left").join(asn, bits, "left")


def asn_edges(ips: DataFrame, ranges: DataFrame, ip: str = "ip", bits: str = "ip_bits") -> DataFrame:
    """BELONGS_TO_ASN edges with the AS asset of each address."""
    found = lookup_asn(ips, ranges, bits)
    pairs = ips.select(ip, bits).distinct().join(found, bits, "inner")
    return pairs.select(
        F.col(ip).alias("source_value"), F.concat(F.lit("AS"), F.col("asn").cast("string")).alias("target_value"),
        F.lit("BELONGS_TO_ASN").alias("relationship_type"), F.lit(0.9).alias("confidence"), "organization", "country",
    )


def dns_enrichment(records: DataFrame, cloud_ranges: DataFrame, asn_ranges: DataFrame, keys: list[str], bits: str = "ip_bits") -> DataFrame:
    """Per key the sorted providers, categories, AS numbers and countries of its addresses.

    The sets hold distinct providers and numbers, not rows; distinct (key, address) pairs are formed first."""
    pairs = records.select(*keys, bits).filter(F.col(bits).isNotNull()).distinct()
    rich = enrich_ips(pairs, cloud_ranges, asn_ranges, bits)
    gather = lambda c: F.array_sort(F.collect_set(c))
    return rich.groupBy(*keys).agg(
        gather("cloud.provider").alias("providers"), gather("cloud.category").alias("categories"),
        gather("asn.number").alias("asns"), gather("asn.country").alias("countries"),
    )


def _free_bits(limit: int) -> int:
    """Host bits of the largest network of at most ``limit`` addresses."""
    return limit.bit_length() - 1


def oversized_cidrs(cidrs: DataFrame, limit: int) -> DataFrame:
    """The networks of more than ``limit`` addresses, which ``expand_cidrs`` leaves out."""
    free = F.when(F.col("ip_version") == 4, 32).otherwise(128) - F.length("net_bits")
    return cidrs.filter(free > _free_bits(limit))


def _listed(skip_edges: bool) -> tuple[Column, Column]:
    """Numbers of the first and the last listed address inside a network, from 0."""
    free = F.when(F.col("ip_version") == 4, 32).otherwise(128) - F.length("net_bits")
    last = F.call_function("shiftleft", F.lit(1), free) - 1
    edges = F.lit(skip_edges) & (F.col("ip_version") == 4) & (free >= 2)
    return F.when(edges, 1).otherwise(0), F.when(edges, last - 1).otherwise(last)


def _member_bits(number: Column) -> Column:
    bits = F.col("net_bits")
    free = F.when(F.col("ip_version") == 4, 32).otherwise(128) - F.length(bits)
    return F.concat(bits, F.when(free > 0, F.lpad(F.bin(number), free, "0")).otherwise(F.lit("")))


def expand_cidrs(cidrs: DataFrame, limit: int, skip_edges: bool = True) -> DataFrame:
    """(columns of ``cidrs``, ip_bits): addresses of each network of at most ``limit`` addresses.

    Base and broadcast address of v4 networks with more than two addresses are skipped.  Larger networks are
    listed by ``oversized_cidrs``; every network is in one of the two."""
    free = F.when(F.col("ip_version") == 4, 32).otherwise(128) - F.length("net_bits")
    small = cidrs.filter(free <= _free_bits(limit))
    return small.withColumn("__n", F.explode(F.sequence(*_listed(skip_edges)))).withColumn("ip_bits", _member_bits(F.col("__n"))).drop("__n")


#: Bits of the prefix by which networks are put in order; a network of the size limit never crosses it.
BUCKET_BITS = {4: 16, 6: 64}
#: Networks of one prefix that one task puts in order.
HOT_NETWORKS = 1 << 20


def _width() -> Column:
    return F.when(F.col("ip_version") == 4, 32).otherwise(128)


def _bucket(bits: Column, limit: int) -> Column:
    four, six = (max(min(BUCKET_BITS[v], w - _free_bits(limit)), 0) for v, w in ((4, 32), (6, 128)))
    return F.substring(bits, F.lit(1), F.when(F.col("ip_version") == 4, four).otherwise(six))


def _follower(bits: Column) -> Column:
    """The bit string of the same length that comes next; NULL after the last one."""
    kept = F.length(F.rtrim(bits, F.lit("1")))
    return F.when(kept > 0, F.concat(F.substring(bits, F.lit(1), kept - 1), F.lit("1"), F.repeat(F.lit("0"), F.length(bits) - kept)))


def turns(ranges: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """(columns of ``ranges``, start): the addresses where a network, or a range from ``first`` to ``last``, begins, and those right behind its end."""
    spots = F.array(*[F.rpad(b, _width(), F.lit("0")) for b in (F.col(first), _follower(F.col(last or first)))])
    return ranges.filter(F.col(first).isNotNull()).withColumn("start", F.explode(spots)).filter(F.col("start").isNotNull())


def expansion_buckets(cidrs: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """(keys, ip_version, bucket, networks): how many networks of at most ``limit`` addresses lie in each bucket."""
    small = cidrs.filter(_width() - F.length("net_bits") <= _free_bits(limit))
    return small.groupBy(*keys, "ip_version", _bucket(F.col("net_bits"), limit).alias("bucket")).agg(F.count(F.lit(1)).alias("networks"))


def expansion_starts(spots: DataFrame, buckets: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """(keys, ip_version, bucket, start): the addresses to look up for all networks of the buckets.

    ``spots``: (keys, ip_version, start), where answers may change.  With them come the starts of their blocks of ``limit`` addresses and those of the buckets,
    so their number follows the spots and the buckets, not the networks or their addresses."""
    on = [*keys, "ip_version", "bucket"]
    used = buckets.select(*on).distinct()
    block = F.rpad(F.substring("start", F.lit(1), F.greatest(_width() - _free_bits(limit), F.lit(0))), _width(), F.lit("0"))
    inside = spots.select(*keys, "ip_version", F.explode(F.array("start", block)).alias("start")).withColumn("bucket", _bucket(F.col("start"), limit)).distinct()
    heads = used.withColumn("start", F.rpad("bucket", _width(), F.lit("0")))
    return inside.join(used, on, "left_semi").select(*on, "start").unionByName(heads).distinct()


def expansion_pieces(cidrs: DataFrame, limit: int, skip_edges: bool = True) -> DataFrame:
    """(columns of ``cidrs``, __from, __to): each network of at most ``limit`` addresses as one piece, from its first to its last listed address."""
    first, last = _listed(skip_edges)
    return cidrs.filter(_width() - F.length("net_bits") <= _free_bits(limit)).withColumns({"__from": first, "__to": last})


def cut_pieces(pieces: DataFrame, answers: Sequence[tuple[DataFrame, list[str], list[str]]], buckets: DataFrame, limit: int) -> DataFrame:
    """Pieces cut where an answer begins, each with the values of the last start at or below it.

    ``answers``: (``expansion_starts`` with their values, keys, values).  Pieces and answers are put in order bucket by bucket, so a piece is shuffled once for
    all answers and meets no key but its own.  An answer travels with the others of its block, as a list that covers the block: a piece never lies in two
    blocks.  Buckets of very many networks are dealt over several tasks."""
    on = ["ip_version", "bucket"]
    hot = buckets.groupBy(*on).agg(F.sum("networks").alias("n")).filter(F.col("n") > HOT_NETWORKS)
    hot = F.broadcast(hot.select(*on, F.ceil(F.col("n") / HOT_NETWORKS).cast("int").alias("__salts")))
    salts, width = F.coalesce(F.col("__salts"), F.lit(1)), _width()

    rows = pieces.withColumn("bucket", _bucket(F.col("net_bits"), limit)).join(hot, on, "left")
    rows = rows.withColumns({"__salt": F.pmod(F.xxhash64(*pieces.columns), salts).cast("int"), "__layer": F.lit(-1), "__turn": F.lit(2)}).drop("__salts")
    for i, (found, keys, values) in enumerate(answers):
        ends = found.withColumn("__stop", F.lead("start").over(Window.partitionBy(*keys, *on).orderBy("start")))
        block = F.substring("start", F.lit(1), F.greatest(width - _free_bits(limit), F.lit(0))).alias("__block")
        lists = ends.groupBy(*keys, *on, block).agg(F.array_sort(F.collect_list(F.struct("start", F.col("__stop").alias("stop"), *values))).alias("__list"))
        # behind the block only its last answer goes on; the list of a following block comes after that
        here = F.struct(F.col("__block").alias("block"), F.lit(1).alias("turn"), F.col("__list").alias("list"))
        behind = F.struct(_follower(F.col("__block")).alias("block"), F.lit(0).alias("turn"), F.slice("__list", -1, 1).alias("list"))
        lists = lists.withColumn("__s", F.explode(F.when(F.size("__list") > 1, F.array(here, behind)).otherwise(F.array(here)))).filter(F.col("__s.block").isNotNull())
        lists = lists.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        lists = lists.select(
            *keys, *on, "__salt", F.col("__s.block").alias("net_bits"), F.lit(0).alias("__from"), F.lit(i).alias("__layer"), F.col("__s.turn").alias("__turn"),
            F.col("__s.list").alias(f"__list{i}"),
        )
        rows = rows.unionByName(lists, allowMissingColumns=True)

    rows, is_piece, here = rows.repartition(*on, "__salt"), F.col("__layer") == -1, _member_bits(F.col("__from"))
    number = lambda bits: F.conv(F.substring(bits, F.length("net_bits") + 1, F.lit(128)), 2, 10).cast("int")
    for i, (_, keys, values) in enumerate(answers):
        column, low, high = f"__list{i}", F.col("__at"), F.col("__end")
        order = Window.partitionBy(*keys, *on, "__salt").orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("__at", here).withColumn(column, F.when(is_piece | (F.col("__layer") == i), F.last(column, ignorenulls=True).over(order)))
        rows = rows.filter(F.col("__layer") != i).withColumn("__end", _member_bits(F.col("__to")))
        over = F.filter(column, lambda a: (a["start"] <= high) & (a["stop"].isNull() | (a["stop"] > low)))
        # the answers still to come pass through
        rows = rows.withColumn("__a", F.explode(F.when(is_piece, over).otherwise(F.array(F.lit(None))))).drop(column)
        start, stop = F.col("__a.start"), F.col("__a.stop")
        rows = rows.withColumns({
            "__from": F.when(start > low, number(start)).otherwise(F.col("__from")), "__to": F.when(stop <= high, number(stop) - 1).otherwise(F.col("__to")),
            **{v: F.col(f"__a.{v}") for v in values},
        }).drop("__a", "__end", "__at")
    return rows.select(*pieces.columns, *[v for _, _, values in answers for v in values])


def expand_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces of networks, with whatever was found for them, as one row per address."""
    rows = pieces.withColumn("__n", F.explode(F.sequence("__from", "__to")))
    return rows.withColumn("ip_bits", _member_bits(F.col("__n"))).drop("__from", "__to", "__n")


def tag_cloud(tags: Column, provider: Column) -> Column:
    """Tag list with ``cloud:<provider>`` appended once."""
    empty = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(provider.isNull(), empty).otherwise(F.array_union(empty, F.array(F.concat(F.lit("cloud:"), provider))))


def asset_id(asset_type: Column, value: Column) -> Column:
    """Deterministic asset id from its identity."""
    return content_id(asset_type, value)


def confidence_of(source: str) -> float:
    return K.SOURCE_CONFIDENCE.get(source, K.DEFAULT_CONFIDENCE)
