"""Building blocks that keep one hot key from landing in one task.

* joins against reference tables: broadcast only when the optimizer's size estimate allows it, else a shuffle join, salted
  as far as the copies of the reference stay within a bound,
* previous-row and row-number computation in two levels (within sub-ranges of a key, then across their
  summaries), so that a key holding a large share of all rows is still spread over many tasks,
* one row per key by aggregation (combined before the shuffle) instead of by window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_BYTES = 64 << 20
SALTS = 16
#: Of a plan's input, as stored, for each task that holds its rows by key.
TASK_BYTES = 1 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the plan's output; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_by_input(df: DataFrame, share: int = 1) -> int | None:
    """Over how many tasks rows are dealt by key, so that what one of them holds does not grow with the input.

    ``share``: how many times ``TASK_BYTES`` a task takes.  None for an input that is small or of unknown size: then the session's number of shuffle partitions
    does.  The estimate of a join multiplies its sides, so the plan's inputs bound it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    inputs = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = min(inputs, estimated_bytes(df))
    tasks = size // (share * TASK_BYTES)
    known = inputs < 1 << 60  # Spark takes 2^63 - 1 where it knows nothing
    return tasks if known and tasks > df.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, tasks: int | None, keys: Sequence[str]) -> DataFrame:
    """Rows by key over that many tasks; grouping by the keys needs no further shuffle."""
    return df if tasks is None else df.repartition(tasks, *keys)


def lookup_join(
    rows: DataFrame, reference: DataFrame, on: Sequence[str], how: str = "left", *, fanout: int = 1,
    spread: Sequence[str] | None = None, size: int | None = None,
) -> DataFrame:
    """Join many rows to a reference table whose join keys may be very unevenly used by the rows.

    Below the size bound the reference is broadcast.  Beyond it each reference row is repeated once per salt and
    the rows carry a salt taken from their own content (``spread``), so a hot key is split and the result stays
    the same when a task is retried.  The larger the reference, the fewer salts: its copies stay within ``SALTS`` times the bound, and one that is larger
    than that is not copied; hot keys are then left to the adaptive planner, which splits the rows.  ``size`` gives the bytes of the reference where the
    caller knows them better than the optimizer's estimate; ``fanout``: rows an explode in the plan makes of one, which the estimate does not see.
    """
    if size is None:
        size = estimated_bytes(reference) * fanout
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(reference), list(on), how)
    salts = min(SALTS, SALTS * BROADCAST_BYTES // size)
    if salts < 2:
        return rows.join(reference, list(on), how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (spread or rows.columns)]), F.lit(salts)).cast("int")
    salted = reference.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", salt).join(salted, [*on, "__salt"], how).drop("__salt")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the smallest ``order`` of each key; ties must be excluded by the order."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*df.columns)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column, out: str = "previous"
) -> DataFrame:
    """Add ``out`` = struct of ``values`` of the preceding row of the same key, NULL for the first.

    ``bucket`` must not decrease along ``order`` (such as the hour of a time stamp).  Rows are shuffled once, by
    key and bucket; only one summary row per key and bucket takes part in the second level.
    """
    rows = df.withColumn("__b", bucket)
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    state = F.struct(*values)
    rows = rows.withColumn("__lag", F.lag(state).over(inside))
    tails = (
        df.withColumn("__b", bucket)
        .groupBy(*keys, "__b")
        .agg(F.max_by(state, F.struct(*order)).alias("__tail"))
    )
    carry = tails.withColumn(
        "__carry", F.lag("__tail").over(Window.partitionBy(*keys).orderBy("__b"))
    ).drop("__tail")
    joined = _join_null_safe(rows, carry, [*keys, "__b"])
    return joined.withColumn(out, F.coalesce("__lag", "__carry")).drop("__lag", "__carry", "__b")


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column, out: str
) -> DataFrame:
    """Mirror image of ``with_previous`` for one value: that of the following row of the same key."""
    rows = df.withColumn("__b", bucket)
    rows = rows.withColumn("__lead", F.lead(value).over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    heads = (
        df.withColumn("__b", bucket).groupBy(*keys, "__b").agg(F.min_by(F.col(value), F.struct(*order)).alias("__head"))
    )
    carry = heads.withColumn(
        "__carry", F.lead("__head").over(Window.partitionBy(*keys).orderBy("__b"))
    ).drop("__head")
    joined = _join_null_safe(rows, carry, [*keys, "__b"])
    return joined.withColumn(out, F.coalesce("__lead", "__carry")).drop("__lead", "__carry", "__b")


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], lead: Sequence[tuple[Column, bool]], out: str = "rank"
) -> DataFrame:
    """Add ``out`` = position of the row within its key along ``order``, starting at 1.

    ``lead``: (expression, ascending) pairs that coarsely follow ``order``; they cut each key into pieces that are
    numbered on their own and then shifted by the number of rows in earlier pieces.
    """
    names = [f"__l{i}" for i in range(len(lead))]
    cut = df.withColumns({n: e for n, (e, _) in zip(names, lead)})
    directions = [F.col(n).asc() if asc else F.col(n).desc() for n, (_, asc) in zip(names, lead)]
    rows = cut.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order)))
    counts = cut.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(*directions).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    joined = _join_null_safe(rows, shift, [*keys, *names])
    return joined.withColumn(out, F.col("__rn") + F.col("__shift")).drop("__rn", "__shift", *names)


def _join_null_safe(rows: DataFrame, summary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner-complete join: every row has exactly one summary row; NULL keys match each other."""
    renamed = summary.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in summary.columns])
    cond = None
    for c in on:
        eq = rows[c].eqNullSafe(renamed[f"__r_{c}"])
        cond = eq if cond is None else cond & eq
    return rows.join(renamed, cond, "left").drop(*[f"__r_{c}" for c in on])
