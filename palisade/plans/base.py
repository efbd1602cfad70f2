"""Shared shapes of the observation plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.enrich import confidence_of
from palisade.operators.skew import with_previous
from palisade.session import scratch_dir

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Observed:
    """Outputs of a plan; all DataFrames.

    rows: validated observations (refused ones included); assets, edges, states: input of ``operators.merge``;
    extra: plan-specific tables."""

    rows: DataFrame
    assets: DataFrame | None = None
    edges: DataFrame | None = None
    states: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


def as_is(df: DataFrame) -> DataFrame:
    return df


def staged(name: str) -> Stage:
    """Write the shared part to the shared scratch folder and go on from the written table: it is computed once, and a
    lost executor costs a re-read instead of a recomputation."""

    def write(df: DataFrame) -> DataFrame:
        path = scratch_dir(df.sparkSession, name)
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    return write


def asset_rows(df: DataFrame, asset_type: Column | str, value: Column, source: str, reason: Column | str) -> DataFrame:
    """Input rows of ``merge.upsert_assets``; ``df`` carries observed_at and seq."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        lit(asset_type).alias("asset_type"), value.alias("value"), F.col("observed_at").alias("seen_at"),
        F.lit(confidence_of(source)).alias("confidence"), F.lit(source).alias("source"), lit(reason).alias("reason"), "seq",
    ).filter(F.col("value").isNotNull())


def edge_rows(
    df: DataFrame, source_value: Column, target_value: Column, relationship: Column | str, source: str, confidence: Column | float,
    metadata: Column | None = None,
) -> DataFrame:
    """Input rows of ``merge.upsert_edges``, ends given by value."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        source_value.alias("source_id"), target_value.alias("target_id"), lit(relationship).alias("relationship_type"),
        F.lit(source).alias("source"), lit(confidence).cast("double").alias("confidence"),
        (F.lit(None).cast("string") if metadata is None else metadata).alias("metadata"), F.col("observed_at").alias("seen_at"), "seq",
    ).filter(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pair_states(obs: DataFrame, stored: DataFrame | None = None, bucket: str = "hour") -> DataFrame:
    """Observations with the state before them.

    obs: (asset_id, facet, observed_at, seq, current, ...); stored: (asset_id, facet, observed_at, current) as left by
    earlier batches.  Adds ``previous``: the state struct preceding the row for the same asset and facet."""
    extra = [c for c in obs.columns if c not in ("asset_id", "facet", "observed_at", "seq", "current")]
    rows = obs.withColumn("__stored", F.lit(False))
    if stored is not None:
        old = stored.select("asset_id", "facet", "observed_at", F.lit(-1).cast("long").alias("seq"), "current").withColumn("__stored", F.lit(True))
        for c in extra:
            old = old.withColumn(c, F.lit(None).cast(obs.schema[c].dataType))
        rows = rows.unionByName(old)
    paired = with_previous(
        rows, ["asset_id", "facet"], ["observed_at", "seq"], ["current"], F.date_trunc(bucket, F.col("observed_at")), "__prev"
    )
    return paired.filter(~F.col("__stored")).withColumn("previous", F.col("__prev.current")).drop("__prev", "__stored")
