"""Hard-negative mining over an inverted multi-index.

The first and the second half of the vectors each get a codebook; a pair of codewords is a cell, and every row is filed under its cell.  A query orders the
codewords of either half by their best possible half score, the inner product with the codeword plus the query's norm times the codeword's radius.  A heap
then visits cells by the sum of both bounds (multi-sequence search), so whatever lies in cells not yet visited scores at most the bound of the next one.

Positives and windows are each found in two rounds: the first visits the best cells until they hold ``FIRST_ROWS`` rows, the second goes on until the bound of
the next cell falls below what was found, which certifies the result as exact.  A round deals (query, shard) visits; a shard is a run of neighbouring cells, or
a part of a large cell, of about ``SHARD_ROWS`` rows, and meets blocks of queries.  The codebooks are fitted on at most ``SAMPLE_ROWS`` rows; all rows are indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import settled, staged

#: Rows that the codebooks are fitted on, and codewords of a half at most.  Both bound what the driver and every task hold of the index.
SAMPLE_ROWS, MOST_WORDS = 16_384, 64
#: Rows of a cell aimed at, of a shard, of a block of queries; rows visited before the first look at the bounds.
CELL_ROWS, SHARD_ROWS, QUERY_BLOCK, FIRST_ROWS = 256, 4_096, 1_024, 2_048
#: Scores must stay below this for exact 64-bit comparisons with percentages.
SCORE_LIMIT = 2**63 // 128


def labelled(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id, label long, v array<long>): floor(256 * x).  Rows with a null id, label or vector, or a null or non-finite component take no part.

    An id that repeats counts once, with its smallest vector and, of equal ones, its smallest label."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * 256).cast("long")).alias("v"), label.cast("long").alias("label"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("m")).select("vec_id", "m.label", "m.v")


def matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest codeword of each row; ties to the first."""
    return ((words**2).sum(1)[None, :] - 2.0 * (x @ words.T)).argmin(1)


def clusters(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Codewords of rows given in a fixed order: k-means from distinct rows spread over that order."""
    found = np.unique(x, axis=0)
    words = found[np.linspace(0, len(found) - 1, min(count, len(found))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        at = nearest(x, words)
        size = np.bincount(at, minlength=len(words)).astype(np.float64)
        sums = np.zeros_like(words)
        np.add.at(sums, at, x)
        words = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], words)
    return words


class MultiIndex:
    """Two codebooks for each vector width, the occupied cells with their radii, and the shards they are filed under."""

    def __init__(self, books: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.books, self.cells, self.reach = books, {}, {}

    def book(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A width outside the sample has one codeword of zeros in either half."""
        return self.books.get(width) or (np.zeros((1, width // 2)), np.zeros((1, width - width // 2)))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codewords of both halves and the distances to them."""
        out, half = [], x.shape[1] // 2
        for part, words in zip((x[:, :half], x[:, half:]), self.book(x.shape[1])):
            at = nearest(part, words)
            out.append((at, np.sqrt(((part - words[at]) ** 2).sum(1))))
        return out[0][0], out[1][0], out[0][1], out[1][1]

    def file(self, rows) -> None:
        """Take the counted cells (width, c1, c2, n, r1, r2) in order and deal their rows to shards."""
        shard, room = -1, 0
        for r in rows:
            if r.n > SHARD_ROWS:
                parts = -(-r.n // SHARD_ROWS)
                first, shard, room = shard + 1, shard + parts, 0
            else:
                parts = 1
                if room < r.n:
                    shard, room = shard + 1, SHARD_ROWS
                first, room = shard, room - r.n
            self.cells.setdefault(r.width, {})[r.c1, r.c2] = (first, parts, r.n)
        for width, cells in self.cells.items():
            self.reach[width] = [np.full(len(b), -np.inf) for b in self.book(width)]
        for r in rows:
            for i, (c, d) in enumerate(((r.c1, r.r1), (r.c2, r.r2))):
                self.reach[r.width][i][c] = max(self.reach[r.width][i][c], d)

    def order(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, c1, c2) of the occupied cells by falling bound: the multi-sequence heap over both sorted lists of half bounds."""
        width, half = len(q), len(q) // 2
        lists = []
        for part, words, reach in zip((q[:half], q[half:]), self.book(width), self.reach.get(width, ([], []))):
            if not len(reach):
                return
            bound = words @ part + np.linalg.norm(part) * reach
            at = np.argsort(-bound, kind="stable")
            at = at[np.isfinite(bound[at])]
            lists.append((bound[at], at))
        (b1, at1), (b2, at2) = lists
        slack = 1.0 + 1e-9 * (abs(b1).max(initial=0.0) + abs(b2).max(initial=0.0))
        cells, heap = self.cells[width], [(-(b1[0] + b2[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if (int(at1[i]), int(at2[j])) in cells:
                yield slack - bound, int(at1[i]), int(at2[j])
            if j + 1 < len(b2):
                heapq.heappush(heap, (-(b1[i] + b2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(b1):
                heapq.heappush(heap, (-(b1[i + 1] + b2[0]), i + 1, 0))

    def visits(self, q: np.ndarray, done: int, need: float | None, first: bool) -> tuple[dict[int, list[int]], int]:
        """Cells to visit now, by shard, after the first ``done`` ones: with ``first`` until they hold FIRST_ROWS rows; never below a bound of ``need``."""
        out, seen, rows, cells = {}, 0, 0, self.cells.get(len(q), {})
        for bound, c1, c2 in self.order(q):
            if (need is not None and bound < need) or (first and rows >= FIRST_ROWS):
                break
            seen += 1
            if seen <= done:
                continue
            start, parts, n = cells[c1, c2]
            rows += n
            for s in range(start, start + parts):
                out.setdefault(s, []).append(c1 * MOST_WORDS + c2)
        return out, max(seen, done)


def fit(vectors: DataFrame) -> MultiIndex:
    """Codebooks from the SAMPLE_ROWS rows whose hashed ids are smallest; about CELL_ROWS rows of the whole table to a cell."""
    n = vectors.count()
    words = int(min(MOST_WORDS, max(1, round((n / CELL_ROWS) ** 0.5))))
    sample = vectors.withColumn("o", F.xxhash64("vec_id")).orderBy("o", "vec_id").limit(SAMPLE_ROWS).select("vec_id", "v", F.size("v").alias("width"))

    def learn(key, rows):
        width = key[0].as_py()
        x = matrix(rows.sort_by("vec_id").column("v"), width).astype(np.float64)
        books = [clusters(h, words) for h in (x[:, : width // 2], x[:, width // 2 :])]
        return pa.table({
            "width": pa.array([width] * sum(map(len, books)), pa.int32()), "half": pa.array([h for h, b in enumerate(books) for _ in b], pa.int32()),
            "at": pa.array([i for b in books for i in range(len(b))], pa.int32()), "word": pa.array([w.tolist() for b in books for w in b], pa.list_(pa.float64())),
        })

    found = sample.groupBy("width").applyInArrow(learn, "width int, half int, at int, word array<double>").orderBy("width", "half", "at").collect()
    books: dict[int, tuple] = {}
    for r in found:
        books.setdefault(r.width, ([], []))[r.half].append(r.word)
    return MultiIndex({w: (np.array(a).reshape(len(a), -1), np.array(b).reshape(len(b), -1)) for w, (a, b) in books.items()})


def indexed(vectors: DataFrame) -> tuple[DataFrame, MultiIndex]:
    """All rows with width, cell and shard, written once, and the index over them."""
    index = fit(vectors)

    def assign(batches):
        for b in batches:
            widths = np.asarray(b.column("width"))
            for width in np.unique(widths):
                part = b.filter(pa.array(widths == width))
                c1, c2, r1, r2 = index.place(matrix(part.column("v"), int(width)).astype(np.float64))
                new = [pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), pa.array(r1), pa.array(r2)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "c1", "c2", "r1", "r2"])

    rows = vectors.select("vec_id", "label", "v", F.size("v").alias("width"))
    rows = staged(rows.mapInArrow(assign, "vec_id long, label long, v array<long>, width int, c1 int, c2 int, r1 double, r2 double"), "cells")
    cells = rows.groupBy("width", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    cells = cells.orderBy("width", "c1", "c2").collect()  # at most MOST_WORDS squared for a width of the sample, one for any other
    index.file(cells)
    table = rows.sparkSession.createDataFrame(
        [(w, c1, c2, start, parts) for w, cs in index.cells.items() for (c1, c2), (start, parts, _) in cs.items()], "width int, c1 int, c2 int, start int, parts int")
    shard = F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    rows = rows.join(F.broadcast(table), ["width", "c1", "c2"]).select("vec_id", "label", "v", "width", (F.col("c1") * MOST_WORDS + F.col("c2")).alias("cell"), shard.alias("shard"))
    return rows, index


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; an error where they might pass SCORE_LIMIT."""
    top = [float(np.abs(m.astype(np.float64)).max(initial=0.0)) for m in (a, b)]
    most = top[0] * top[1] * max(1, a.shape[1])
    if most >= SCORE_LIMIT:
        raise OverflowError("inner products of these components may pass the range in which scores are exact")
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.stack([(q[None, :] * b).sum(axis=1) for q in a])


def heads(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the n best allowed scores of every row, ties to the smaller column."""
    rows, cols = np.nonzero(allowed)
    best = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[best], cols[best]
    start = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - start < n
    return rows[keep], cols[keep]


def top_allowed(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``heads``, after a cut at the n-th best score of each row."""
    if scores.shape[1] > 4 * n:
        masked = np.where(allowed, scores, np.iinfo(np.int64).min)
        allowed = allowed & (scores >= np.partition(masked, -n, axis=1)[:, -n][:, None])
    return heads(scores, allowed, n)


FOUND = "anchor_id long, positive_id long, vec_id long, score long"


class Search:
    """Rounds of visits over one index."""

    def __init__(self, rows: DataFrame, index: MultiIndex, anchors: DataFrame) -> None:
        self.rows, self.index = rows, index
        self.blocks = max(1, -(-anchors.count() // QUERY_BLOCK))

    def visit(self, state: DataFrame, first: bool) -> DataFrame:
        """``state`` (anchor_id, label, v, width, windows, done, need) with one row per shard to visit (shard null: none) and ``done`` moved on."""
        index = self.index

        def walk(batches):
            for b in batches:
                at, shards, cells, done = [], [], [], []
                for i, (v, d, need) in enumerate(zip(b.column("v"), b.column("done").to_pylist(), b.column("need").to_pylist())):
                    out, seen = index.visits(np.array(v.as_py(), np.float64), d, need, first)
                    for s, cs in out.items() or ((None, []),):
                        at.append(i), shards.append(s), cells.append(cs), done.append(seen)
                part = b.take(pa.array(at, pa.int64()))
                put = {"done": pa.array(done, pa.int32()), "shard": pa.array(shards, pa.int32()), "cells": pa.array(cells, pa.list_(pa.int32()))}
                for name, values in put.items():
                    if name in part.schema.names:
                        part = part.set_column(part.schema.get_field_index(name), name, values)
                    else:
                        part = part.append_column(name, values)
                yield part

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
        return staged(state.mapInArrow(walk, f"{fields}, shard int, cells array<int>"), "visits")

    def scored(self, visits: DataFrame, n: int) -> DataFrame:
        """(anchor_id, positive_id, vec_id, score): the n best of every window in each shard.

        Windows are structs (positive_id, low, high): percentages are compared as 100 * score, with rows of another label; a null positive_id stands for the
        search of rows of the anchor's own label."""
        blocks = self.blocks
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        q = visits.filter("shard IS NOT NULL").withColumn("qb", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
        c = self.rows.withColumn("qb", every)

        def score(key, a, b):
            out = {name: [] for name in ("anchor_id", "positive_id", "vec_id", "score")}
            if a.num_rows and b.num_rows:
                b = b.sort_by("vec_id")
                width = key[0].as_py()
                s = exact_scores(matrix(a.column("v"), width), matrix(b.column("v"), width))
                ids, anchor = b.column("vec_id").to_numpy(), a.column("anchor_id").to_numpy()
                names, where = np.unique(b.column("cell").to_numpy(), return_inverse=True)
                seen = np.zeros((len(anchor), len(names)), bool)
                for i, cells in enumerate(a.column("cells").to_pylist()):
                    seen[i] = np.isin(names, cells)
                same = a.column("label").to_numpy()[:, None] == b.column("label").to_numpy()[None, :]
                seen = seen[:, where] & (anchor[:, None] != ids[None, :])
                windows = a.column("windows").to_pylist()
                for w in range(max(map(len, windows), default=0)):
                    has = np.array([len(x) > w for x in windows])
                    pos = [x[w]["positive_id"] if len(x) > w else None for x in windows]
                    own = np.array([p is None for p in pos])
                    low, high = (np.array([x[w][k] if len(x) > w and x[w][k] is not None else 0 for x in windows], np.int64)[:, None] for k in ("low", "high"))
                    fits = np.where(own[:, None], same, ~same & (100 * s >= low) & (100 * s <= high))
                    r, k = top_allowed(s, fits & seen & has[:, None], n)
                    out["anchor_id"].append(anchor[r])
                    out["positive_id"].extend(pos[i] for i in r)
                    out["vec_id"].append(ids[k])
                    out["score"].append(s[r, k])
            flat = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items() if k != "positive_id"}
            return pa.table({"anchor_id": flat["anchor_id"], "positive_id": pa.array(out["positive_id"], pa.int64()), "vec_id": flat["vec_id"], "score": flat["score"]})

        keys = ["width", "shard", "qb"]
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(score, FOUND)

    def rounds(self, state: DataFrame, n: int, need: Column) -> DataFrame:
        """The n best rows of every window, exact.  ``need`` is what a window still asks for, from its found count ``k`` and least score ``least``."""
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
        visits = self.visit(state.withColumn("done", F.lit(0)), True)
        found = staged(best(self.scored(visits, n)).drop("rank"), "found")
        had = found.groupBy("anchor_id", "positive_id").agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("least"))
        once = visits.dropDuplicates(["anchor_id"]).drop("shard", "cells")
        windows = once.select("anchor_id", F.explode("windows").alias("w"), F.col("need").alias("floor")).select("anchor_id", "w.*", "floor")
        asked = windows.join(had.withColumnsRenamed({"anchor_id": "a", "positive_id": "p"}), (F.col("anchor_id") == F.col("a")) & F.col("positive_id").eqNullSafe(F.col("p")), "left")
        asked = asked.groupBy("anchor_id").agg(F.max(need.isNull()).alias("open"), F.min(need).alias("least_need"))
        asked = asked.select("anchor_id", F.when(F.col("open"), F.lit(None)).otherwise(F.col("least_need")).alias("need"))
        again = self.visit(once.drop("need").join(asked, "anchor_id").select(*state.columns, "done"), False)
        return best(found.unionByName(self.scored(again, n)))


@settled("negatives")
def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor and positive.

    ``vectors`` (see ``labelled``) has distinct vec_id; ``anchors`` has the vec_id of the anchors.  Positives are an anchor's ``positives`` best other rows of its
    label, negatives the ``negatives`` best rows of other labels whose score is from ``low`` to ``high`` per cent of the positive's.  Higher scores come first, ties
    go to the smaller vec_id; fewer are returned where there are fewer.  Vectors of another length never meet.  A negative positive score has an empty
    window; zero has only scores of zero.  Empty tables, and anchors alone in their label, give no row.  Components whose products might pass 2**56 are an error.
    """
    rows, index = indexed(vectors)
    rows = staged(rows, "index")
    ids = anchors.select(F.col("vec_id").alias("anchor_id")).distinct()
    asked = staged(rows.join(ids, rows["vec_id"] == ids["anchor_id"]).select("anchor_id", "label", "v", "width"), "anchors")
    search = Search(rows, index, asked)
    window = "struct<positive_id:bigint,low:bigint,high:bigint>"
    own = F.array(F.struct(*(F.lit(None).cast("long").alias(x) for x in ("positive_id", "low", "high"))).cast(window))
    start = asked.withColumn("windows", own).withColumn("need", F.lit(None).cast("double"))
    found = search.rounds(start, positives, F.when(F.col("k") >= positives, F.col("least")).cast("double"))
    found = staged(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    span = F.struct("positive_id", (F.col("positive_score") * low).alias("low"), (F.col("positive_score") * high).alias("high"))
    spans = found.filter("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(span)).cast(f"array<{window}>").alias("windows"), (F.min("positive_score") * low / 100).alias("need"))
    start = asked.join(spans, "anchor_id").select(*start.columns)
    least = F.greatest(F.col("floor"), F.when(F.col("k") >= negatives, F.col("least")).otherwise(F.col("low") / 100))
    hard = search.rounds(start, negatives, least.cast("double"))
    return hard.join(found, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(a.v) = len(c.v)),
g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
h AS (SELECT g.*, p.vec_id AS negative_id, p.score AS negative_score,
    row_number() OVER (PARTITION BY g.anchor_id, g.positive_id ORDER BY p.score DESC, p.vec_id) AS rank
  FROM g JOIN p ON p.anchor_id = g.anchor_id AND NOT p.same AND 50 * positive_score <= 100 * p.score AND 100 * p.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3
"""
