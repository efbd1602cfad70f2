"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are cut into LISTS runs; for a query, each run gives a score list over all candidates, and a candidate's score is the sum of
its entries.  Candidates and queries are dealt into blocks of bounded size, one group per pair of blocks.

1. Every group gathers the heads of its local score lists with their sums; the k-th best sum of a query is a safe cutoff c.
2. The cutoff goes to every group, which collects all entries of at least c / LISTS in any list.  A candidate that is below that in every
   list sums to less than c, so nothing else can be among the best k, ties included.
3. What the collected candidates lack, their entries in the other lists, is resolved exactly from the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import staged

LISTS = 2
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating-point matrix product where every sum is exact in it, else in 64-bit integers."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(candidates)), np.int64)
    top = lambda m: float(np.abs(m.astype(np.float64)).max()) if m.size else 0.0
    if top(queries) * top(candidates) * queries.shape[1] < 2**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return np.stack([(q[None, :] * candidates).sum(axis=1) for q in queries])


def runs(width: int) -> list[slice]:
    cuts = [width * i // LISTS for i in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<long>): floor(256 * x); vectors that are null or hold null or non-finite components are left out, as are null ids.

    An id that repeats counts once, with its smallest vector."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.select(F.col(id_col).alias("vec_id"), F.transform(x, lambda e: F.floor(e * 256).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query; all, if there are fewer.

    ``queries`` and ``candidates``: vec_id, v array<long> with distinct ids.  Ties go to the smaller id; a query's own id and vectors of another
    length are no candidates.  Equal vectors form one class, searched once: as its members tie, only its k + 1 smallest ids can be
    among the best, one of them being the query itself.  Empty tables give no row.
    """
    keep = k + 1
    hashed = candidates.withColumn("h", F.xxhash64("v"))
    first = hashed.withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).filter(F.col("n") <= keep)
    classes = first.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = staged(classes.select(F.col("ids")[0].alias("class"), "ids", "v", F.size("v").alias("width")), "classes")
    queries = staged(queries.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("width")), "queries")
    q_blocks, c_blocks = (max(1, -(-t.count() // n)) for t, n in ((queries, QUERY_BLOCK), (classes, CANDIDATE_BLOCK)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["width", "qb", "cb"]
    c_side = classes.select("class", "v", "width", block("class", c_blocks).alias("cb"), every(q_blocks).alias("qb"))

    def q_side(extra):
        return queries.join(extra, "query_id") if extra is not None else queries

    def dealt(extra=None):
        q = q_side(extra)
        return q.select(*q.columns, block("query_id", q_blocks).alias("qb"), every(c_blocks).alias("cb")).groupBy(*keys).cogroup(c_side.groupBy(*keys))

    def parts_of(key, q, c):
        width = key[0].as_py()
        a, b = matrix(q.column("v"), width), matrix(c.column("v"), width)
        return [scores(a[:, s], b[:, s]) for s in runs(width)], q.column("query_id").to_numpy(), c.column("class").to_numpy()

    def gather(key, q, c):
        if not q.num_rows or not c.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        parts, qid, cid = parts_of(key, q, c)
        n = min(keep, len(cid))
        heads = np.concatenate([np.argpartition(-p, n - 1, axis=1)[:, :n] for p in parts], axis=1)
        heads.sort(axis=1)
        total = sum(np.take_along_axis(p, heads, axis=1) for p in parts)
        again = np.zeros(heads.shape, bool)
        again[:, 1:] = heads[:, 1:] == heads[:, :-1]
        ids, sums = np.repeat(qid, heads.shape[1]).reshape(heads.shape)[~again], total[~again]
        return pa.table({"query_id": ids, "score": sums})

    gathered = dealt().applyInArrow(gather, "query_id long, score long")
    nth = gathered.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("n") <= keep)
    cutoffs = nth.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == keep, F.min("score")).alias("cutoff"))

    def collect(key, q, c):
        none = pa.table({"query_id": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "known": pa.array([], pa.int64()), "lists": pa.array([], pa.int32())})
        if not q.num_rows or not c.num_rows:
            return none
        parts, qid, cid = parts_of(key, q, c)
        cutoff = q.column("cutoff")
        bound = cutoff.fill_null(0).to_numpy()[:, None]
        open_ = cutoff.is_null().to_numpy(zero_copy_only=False)[:, None]
        sent = [(p * LISTS >= bound) | open_ for p in parts]
        row, col = np.nonzero(np.logical_or.reduce(sent))
        known = sum(np.where(s[row, col], p[row, col], 0) for s, p in zip(sent, parts))
        lists = sum(s[row, col].astype(np.int32) << i for i, s in enumerate(sent))
        return pa.table({"query_id": qid[row], "class": cid[col], "known": known, "lists": lists.astype(np.int32)})

    entries = dealt(cutoffs).applyInArrow(collect, "query_id long, class long, known long, lists int")
    met = entries.join(queries.select("query_id", "v", "width"), "query_id")
    met = met.join(classes.select("class", "ids", F.col("v").alias("w")), "class")
    missing = [
        F.when((F.col("lists").bitwiseAND(1 << i)) != 0, F.lit(0).cast("long")).otherwise(F.aggregate(
            F.zip_with(run(F.col("v"), i), run(F.col("w"), i), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b))
        for i in range(LISTS)
    ]
    scored = met.select("query_id", "class", "ids", sum(missing, F.col("known")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "class")
    heads = scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= keep)
    rows = heads.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def run(vector, i: int):
    """The i-th of the LISTS runs of an array column; same cuts as ``runs``."""
    at = lambda n: (F.size(vector) * n / LISTS).cast("int")
    return F.slice(vector, at(i) + 1, at(i + 1) - at(i))


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
