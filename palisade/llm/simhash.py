"""SimHash fingerprints and near-duplicates within a Hamming distance, found in vantage-point trees.

Two fingerprints that differ in at most ``radius`` of 64 bits differ in at most radius // 4 bits in one of four quarters.  The 16-bit values of
a quarter are cut by one fixed vantage-point tree into LEAVES regions; every distinct fingerprint lives in one region per quarter and, by the
triangle bounds of the vantage points on the way down, also visits the regions that its ball overlaps.  Each region is a shard; inside, a
vantage-point tree over whole fingerprints is searched for exact pairs.  Shards with many fingerprints are split into parts, and a shard
returns a spanning forest of its pairs instead of the pairs, so neither time nor rows follow the square of a group of copies.
"""

from __future__ import annotations

import functools
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import components, spaced_words, staged

SEED = 42
LEAVES = 512
#: Fingerprints of a shard that one task holds against all visitors.
PART = 8192


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by spaces; of the whole sequence if it is shorter; empty without words."""
    if not words:
        return np.empty(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(line, SEED)], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.fromiter((h(line[s : e - 1], SEED) for s, e in zip(ends, ends[size:])), np.uint64, len(words) - size + 1)


def fingerprint(words: list[bytes], size: int) -> int:
    """Bit i is 1 if it is set in over half the hashes; as a signed 64-bit number."""
    hashes = shingle_hashes(words, size)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]) if len(hashes) else 0


def with_fingerprints(docs: DataFrame, text_col: str = "text", size: int = 4, out: str = "fingerprint") -> DataFrame:
    """The rows with a long column of their fingerprint; null and empty texts have 0."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != out], T.StructField(out, T.LongType())])

    def add(batches):
        for b in batches:
            prints = [fingerprint(spaced_words(t), size) for t in b.column(text_col).to_pylist()]
            kept = [n for n in b.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(prints, pa.int64())], names=[*kept, out])

    return docs.mapInArrow(add, schema)


@functools.cache
def regions(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree over all 16-bit values: region of each value; and, as offsets and numbers, the regions from its own on that a ball
    of ``reach`` around the value overlaps."""
    rng, home, visits = np.random.default_rng(7), np.zeros(1 << 16, np.int32), []

    def cut(inside, guests, leaves):
        if leaves == 1:
            near = guests[(np.bitwise_count(guests[:, None] ^ inside[None, :]) <= reach).any(axis=1)]
            home[inside] = len(visits)
            visits.append(near)
            return
        point = rng.choice(inside)
        d, g = np.bitwise_count(inside ^ point), np.bitwise_count(guests ^ point)
        r = np.sort(d)[(len(d) - 1) // 2]
        if not (d > r).any():
            r -= 1
        cut(inside[d <= r], guests[g <= r + reach], leaves // 2)
        cut(inside[d > r], guests[g > r - reach], leaves - leaves // 2)

    every = np.arange(1 << 16, dtype=np.uint16)
    cut(every, every, LEAVES)
    value = np.concatenate(visits)
    region = np.repeat(np.arange(len(visits), dtype=np.int32), [len(v) for v in visits])
    later = region >= home[value]
    value, region = value[later], region[later]
    order = np.lexsort((region, value))
    return home, np.searchsorted(value[order], np.arange((1 << 16) + 1)), region[order]


def quarters(prints: np.ndarray) -> list[np.ndarray]:
    return [((prints >> np.uint64(16 * q)) & np.uint64(0xFFFF)).astype(np.int64) for q in range(4)]


def near_blocks(homes: np.ndarray, guests: np.ndarray, radius: int):
    """Index arrays (homes, guests) of blocks that hold every pair within the radius: a vantage-point tree over the homes."""
    todo = [(np.arange(len(homes)), np.arange(len(guests)), 0)]
    while todo:
        h, g, depth = todo.pop()
        if not len(h) or not len(g):
            continue
        if len(h) > 256 and depth < 12:
            point = homes[h[(7919 * (depth + 1)) % len(h)]]
            dh, dg = np.bitwise_count(homes[h] ^ point).astype(np.int16), np.bitwise_count(guests[g] ^ point).astype(np.int16)
            r = np.sort(dh)[(len(dh) - 1) // 2]
            if (dh > r).any():
                todo += [(h[dh <= r], g[dg <= r + radius], depth + 1), (h[dh > r], g[dg > r - radius], depth + 1)]
                continue
        for i in range(0, len(h), 256):
            for j in range(0, len(g), 4096):
                yield h[i : i + 256], g[j : j + 4096]


def forest(homes: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) of a spanning forest of all pairs within the radius between homes and homes or guests."""
    values, inverse = np.unique(np.concatenate([homes, guests]), return_inverse=True)
    h, g = inverse[: len(homes)], np.unique(inverse)
    label = np.arange(len(values))

    def join(pairs):
        nonlocal label
        for a, b in pairs:
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            label[max(a, b)] = min(a, b)
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump

    for i, j in near_blocks(values[h], values[g], radius):
        hi, gj = h[i], g[j]
        met = np.bitwise_count(values[hi][:, None] ^ values[gj][None, :]) <= radius
        met &= label[hi][:, None] != label[gj][None, :]
        if not met.any():
            continue
        some = met.any(axis=0)
        join(zip(gj[some].tolist(), hi[met.argmax(axis=0)[some]].tolist()))
        a, b = np.nonzero(met)
        a, b = label[hi[a]], label[gj[b]]
        left = a != b
        if left.any():
            join(np.unique(np.stack([a[left], b[left]], axis=1), axis=0).tolist())
    linked = label != np.arange(len(values))
    return values[linked].view(np.int64), values[label[linked]].view(np.int64)


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) over the distinct ``fingerprint`` values that connect exactly those within ``radius`` bits, directly or in steps."""
    reach = radius // 4
    prints = staged(prints.select("fingerprint").filter("fingerprint IS NOT NULL").distinct(), "prints")

    def count(batches):
        total = np.zeros((4, LEAVES), np.int64)
        for b in batches:
            for q, v in enumerate(quarters(b.column(0).to_numpy().view(np.uint64))):
                total[q] += np.bincount(regions(reach)[0][v], minlength=LEAVES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 * LEAVES)), pa.array(total.ravel())], names=["shard", "n"])

    # 4 * LEAVES rows, whatever the size of the input
    sizes = prints.mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    parts = np.ones(4 * LEAVES, np.int64)
    for r in sizes:
        parts[r["shard"]] = max(1, -(-r["n"] // PART))

    def deal(batches):
        home, start, region = regions(reach)
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for q, v in enumerate(quarters(fp)):
                n = start[v + 1] - start[v]
                row = np.repeat(np.arange(len(fp)), n)
                at = np.repeat(start[v] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shard, own = q * LEAVES + region[at], region[at] == home[v][row]
                copies = parts[shard]
                row, shard, own, copies = (np.repeat(x, copies) for x in (row, shard, own, copies))
                part = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(parts[q * LEAVES + region[at]])[:-1]]), parts[q * LEAVES + region[at]])
                mine = (fp[row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % copies
                for i in range(0, len(row), 50_000):
                    s = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard[s].astype(np.int64)), pa.array(part[s]), pa.array(fp[row[s]].view(np.int64)), pa.array(own[s] & (part[s] == mine[s]))],
                        names=["shard", "part", "fp", "home"])

    def search(table):
        fp, own = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(zero_copy_only=False)
        a, b = forest(fp[own], fp[~own], radius)
        return pa.table({"a": a, "b": b})

    return prints.mapInArrow(deal, "shard long, part long, fp long, home boolean").groupBy("shard", "part").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of rows that have a ``fingerprint``.

    component_id is the smallest id reachable over links of at most ``radius`` differing bits, its own included.  Equal fingerprints
    (copies, also all texts without words) are one class and are joined back; repeated rows each give a row; null ids get the
    component's smallest id, null if it has none.  An empty table gives no row.
    """
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), "fingerprint"), "docprints")
    linked = staged(components(links(rows, radius)), "components")
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    classes = classes.join(linked, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(classes.join(ids, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_print(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
