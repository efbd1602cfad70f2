"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import SPACED_WORD, staged

#: Pieces of a source's shuffled order that are summed on their own; a source of any size is spread over so many groups.
PIECES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """One row per source with ``source_size`` and ``target`` words.

    ``sizes``: source, source_size (null source allowed).  Sources by code point, null last, take the weights in turn and
    share the sum of all sizes; a share stops at ``max_repeats`` times the source and the excess goes to the others by weight.
    Sorted by cap per weight, a source is capped if its cap is below its part of what those before it left.  The windows run over one row
    per source of the mixture, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), turn + 1))
    rows = rows.withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*", F.sum("source_size").over(whole).alias("budget"), F.sum("w").over(whole).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    rows = rows.withColumn("capped", F.col("cap") * (F.col("all_w") - F.col("w_before")) < F.col("w") * (F.col("budget") - F.col("cap_before")))
    used = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0)).over(whole)
    rows = rows.withColumns({"left": F.col("budget") - used("cap"), "left_w": F.col("all_w") - used("w")})
    share = (F.col("left") * F.col("w")).cast("double") / F.col("left_w").cast("double")
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix", id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, virtual_finish; sorted by virtual_finish.

    Each source's documents are put in the order of a hash of ``seed`` and id (ids that repeat: by size).  A document's virtual
    finish time is the cumulative number of its source's words up to its end, divided by the source's target; a further copy
    finishes one source size later.  Served by finish time, every source has received exactly its target at time 1, where the total budget is
    spent: the queue is cut there.  A document that is being served at the cut is cut there too, so a source's taken words equal its target
    but for the fraction of a word.  No copy beyond ``max_repeats`` can start before time 1, as targets stop at so many source sizes.

    The order and the sums come from the data only: reruns agree.  Null text and empty text: size 0, nothing taken, finish time that of the
    words before.  Null ids and sources are values of their own.  Repeated rows are documents of their own.  An empty table gives no row.
    All sizes 0: targets 0, virtual_finish null.  Columns in ``carry`` are passed on; others are not read.

    The running sum is made in two levels: inside one of PIECES pieces of a source, then over one sum per piece.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("k"), *carry,
    )
    rows = staged(rows.withColumn("piece", F.conv(F.substring("k", 1, 3), 16, 10).cast("int") % PIECES), "mix")
    pieces = rows.groupBy("source", "piece").agg(F.sum("size").alias("piece_size"))
    targets = source_targets(pieces.groupBy("source").agg(F.sum("piece_size").alias("source_size")), weights, max_repeats)
    upto = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("offset", F.coalesce(F.sum("piece_size").over(upto), F.lit(0)))
    pieces = pieces.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "piece_size")
    pieces = pieces.select(F.col("source").alias("s"), F.col("piece").alias("p"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "piece").orderBy("k", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.join(pieces, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
    rows = rows.withColumn("finish", F.col("offset") + F.col("upto"))
    left = lambda copy: F.floor("target").cast("long") - (F.col("finish") - F.col("size") + copy * F.col("source_size"))
    served = [F.greatest(F.lit(0).cast("long"), F.least("size", left(i))) for i in range(max_repeats)]
    return rows.select(
        *carry, "doc_id", "source", "size", "source_size", "target", sum(served[1:], served[0]).alias("taken"),
        sum([(s > 0).cast("int") for s in served[1:]], (served[0] > 0).cast("int")).alias("copies"),
        F.when(F.col("target") > 0, F.col("finish") / F.col("target")).alias("virtual_finish"),
    ).orderBy(F.col("virtual_finish").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::BIGINT AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before FROM s1
  WINDOW o AS (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * (all_w - w_before) < w * (budget - cap_before) AS capped FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
  ((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * w)::DOUBLE / (all_w - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())::DOUBLE END AS target FROM s3),
r AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS finish
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
t AS (SELECT *, floor(target)::BIGINT - finish + size AS room FROM r)
SELECT doc_id, size, source_size, target,
 (greatest(0, least(size, room)) + greatest(0, least(size, room - source_size)) + greatest(0, least(size, room - 2 * source_size)))::BIGINT AS taken FROM t
"""
