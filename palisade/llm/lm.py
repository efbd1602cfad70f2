"""Scoring by a word n-gram model as a weighted backoff automaton.

States are histories: none, one word, two words.  An arc of a state reads a word and carries the probability of the word after that history; a failure
arc carries the backoff weight to the state of the shorter history.  All positions of a block of texts take their arcs at once.

The word table grows with the corpus and fits no task, so texts are cut into blocks of bounded size, which are kept as numbers of the block's own words; each
block counts its words and n-grams once.  Every word has a number in the corpus too and may stand in n-grams.  N-grams go by hash to shards; a two-word n-gram
lies in one shard with all that follow it, so a shard counts both, weighs both, and answers each block in the order in which the block listed its n-grams.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import fold, settled, spaced_words, staged

#: The end of a text; cannot occur inside a word.
END = b"\n"
BLOCK_CHARS = 8 << 20
#: Text that one shard of n-grams stands for, at most.
SHARD_CHARS = 8 << 20


def tokens(text: str | None) -> list[bytes]:
    return [*spaced_words(text), END]


def packed(a: np.ndarray) -> bytes:
    """The numbers byte by byte, high bytes together, compressed."""
    flat = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(flat).to_bytes(8, "little") + pa.compress(flat, "zstd", asbytes=True)


def unpacked(part: bytes, kind) -> np.ndarray:
    flat = pa.decompress(part[8:], int.from_bytes(part[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def all_of(column, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(unpacked(x, kind) for x in column.to_pylist())])


def blocks_and_counts(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of two kinds from (id, text, train): 0, each block with its documents (ids, train; sizes: numbers of tokens) and all their tokens as numbers of
    the block's words (codes), the most frequent first; 1, the words of each block (word, id: its number) with their count n in its training documents (0: only in
    others).  Written before use, so that a block stays the same when tasks run again."""
    id_type = docs.schema["doc_id"].dataType

    def cut(batches):
        at, size = TaskContext.get().partitionId() << 30, 0
        known, found, ids, train = fresh(), [], [], []
        for b in batches:
            column, counted = b.column("doc_id"), b.column("train").to_pylist()
            for i, text in enumerate(b.column("text").to_pylist()):
                found.append(np.array([known[w] for w in tokens(text)], np.uint32))
                ids.append(column.slice(i, 1))
                train.append(counted[i])
                size += len(text or "") + 1
                if size >= block_chars:
                    yield from rows(at, known, found, ids, train)
                    at, size = at + 1, 0
                    known, found, ids, train = fresh(), [], [], []
            if ids:
                ids = [pa.concat_arrays(ids)]
        if found:
            yield from rows(at, known, found, ids, train)

    def fresh():
        known: dict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        return known

    def rows(at, known, found, ids, train):
        sizes, codes = np.array([len(x) for x in found], np.uint32), np.concatenate(found)
        order = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        codes = rank[codes]
        n = np.bincount(codes[np.repeat(np.array(train, bool), sizes)], minlength=len(known))
        words = pa.array(list(known), pa.binary()).take(pa.array(order)).cast(pa.string())
        none = lambda k, *kinds: [pa.nulls(k, x) for x in kinds]
        listed = [pa.ListArray.from_arrays(pa.array([0, len(train)], pa.int32()), x) for x in (pa.concat_arrays(ids), pa.array(train, pa.bool_()))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([at]), *listed, pa.array([packed(sizes)]), pa.array([packed(codes)]), *none(1, pa.string(), pa.int32(), pa.int64())], names=names)
        k = len(words)
        whole = pa.RecordBatch.from_arrays(
            [pa.array(np.ones(k, np.int32)), pa.array(np.full(k, at)), *none(k, listed[0].type, listed[1].type, pa.binary(), pa.binary()), words,
             pa.array(np.arange(k, dtype=np.int32)), pa.array(n.astype(np.int64))], names=names)
        for i in range(0, k, 50_000):
            yield whole.slice(i, 50_000)

    names = ["kind", "block", "ids", "train", "sizes", "codes", "word", "id", "n"]
    kinds = f"kind int, block long, ids array<{id_type.simpleString()}>, train array<boolean>, sizes binary, codes binary, word string, id int, n long"
    return staged(docs.select("doc_id", "text", "train").mapInArrow(cut, kinds), "lm-blocks", ["kind"])


def counted_words(per_block: DataFrame) -> DataFrame:
    """(block, id, gid, c, once) from (block, id, word, n), written: the number and count of the word in the corpus; ``once`` marks one row of each word.

    One row per word and block, so a frequent word has as many rows as there are blocks."""
    same = Window.partitionBy("word")
    numbered = per_block.repartition("word").withColumn("row", F.monotonically_increasing_id())
    numbered = numbered.select("block", "id", "row", F.min("row").over(same).alias("gid"), F.sum("n").over(same).alias("c"))
    return staged(numbered.select("block", "id", "gid", "c", (F.col("row") == F.col("gid")).alias("once")), "lm-words")


def shard_of(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of a hash of two words' numbers."""
    if not bits:
        return np.zeros(len(a), np.int64)
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(64 - bits)).astype(np.int64)


class Block:
    """The texts of a block and its n-grams in a fixed order, two-word ones by shard, three-word ones by their front.

    a, b: words of the two-word n-grams; pair: which of them ends at each token, or -1; front, last: front and last word of the three-word ones; run: which of
    them ends at each token, or -1.  ``floors``: least counts of words in two-word and in three-word n-grams."""

    def __init__(self, row, words, bits: int, floors: tuple[float, float] | None) -> None:
        self.sizes = unpacked(row.column("sizes")[0].as_py(), np.uint32).astype(np.int64)
        self.codes = code = unpacked(row.column("codes")[0].as_py(), np.uint32).astype(np.int32)
        at = words.column("id").to_numpy()
        self.gid, self.c = np.empty(len(at), np.int64), np.zeros(len(at), np.int64)
        self.gid[at] = words.column("gid").to_numpy()
        if "c" in words.column_names:
            self.c[at] = words.column("c").to_numpy()
        self.starts = np.cumsum(self.sizes) - self.sizes
        first = np.zeros(len(code), bool)
        first[self.starts] = True
        second = ~first
        third = second.copy()
        third[1:] &= second[:-1]
        self.follows, self.ends = second, third
        if floors is not None:
            wide, narrow = ((self.c >= x)[code] for x in floors)
            second = second & wide
            second[1:] &= wide[:-1]
            narrow &= wide
            third = third & narrow
            third[1:] &= narrow[:-1]
            third[2:] &= narrow[:-2]
        at = np.flatnonzero(second)
        grams, which = np.unique(code[at - 1].astype(np.int64) << 32 | code[at], return_inverse=True)
        a, b = (grams >> 32).astype(np.int32), (grams & 0xFFFFFFFF).astype(np.int32)
        shard = shard_of(self.gid[a], self.gid[b], bits)
        order = np.argsort(shard, kind="stable")
        self.a, self.b, self.shard = a[order], b[order], shard[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.pair = np.full(len(code), -1, np.int32)
        self.pair[at] = rank[which]
        del grams, which, a, b, shard, order, rank  # as large as the texts
        at = np.flatnonzero(third)
        grams, which = np.unique(self.pair[at - 1].astype(np.int64) << 32 | code[at], return_inverse=True)
        self.front, self.last = (grams >> 32).astype(np.int32), (grams & 0xFFFFFFFF).astype(np.int32)
        self.run = np.full(len(code), -1, np.int32)
        self.run[at] = which


def deltas(a: np.ndarray) -> bytes:
    return packed(np.diff(a, prepend=0))


def numbered(gid: np.ndarray, *places: np.ndarray) -> list[bytes]:
    """The sorted corpus numbers of the words that occur in the lists of places of ``gid``, and the lists by these."""
    used, which = np.unique(np.concatenate([gid[x] for x in places]), return_inverse=True)
    return [deltas(used), *(packed(x.astype(np.uint32)) for x in np.split(which, np.cumsum([len(x) for x in places])[:-1]))]


def block_grams(texts: DataFrame, counted: DataFrame, bits: int, floors: tuple[float, float] | None) -> DataFrame:
    """One row per shard and block: corpus numbers of words; the block's two-word n-grams (a, b: places of their words), their count in training documents (n),
    how many different words follow (k), and those words (w3) with the count of the three-word n-gram (n3)."""
    names = ["shard", "block", "words", "a", "b", "n", "k", "w3", "n3"]

    def count(key, row, words):
        block = Block(row, words, bits, floors)
        train = np.repeat(np.array(row.column("train")[0].as_py(), bool), block.sizes)
        n = np.bincount(block.pair[train & (block.pair >= 0)], minlength=len(block.a)).astype(np.uint32)
        n3 = np.bincount(block.run[train & (block.run >= 0)], minlength=len(block.front)).astype(np.uint32)
        k = np.bincount(block.front, minlength=len(block.a)).astype(np.uint32)
        after = np.concatenate([[0], np.cumsum(k, dtype=np.int64)])
        starts = np.flatnonzero(np.diff(block.shard, prepend=-1))
        out = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(block.a)]):
            x, y = after[s], after[e]
            gids, one, two, three = numbered(block.gid, block.a[s:e], block.b[s:e], block.last[x:y])
            out.append((int(block.shard[s]), key[0].as_py(), gids, one, two, packed(n[s:e]), packed(k[s:e]), three, packed(n3[x:y])))
        shard, at, *parts = zip(*out) if out else [()] * len(names)
        return pa.table([pa.array(shard, pa.int32()), pa.array(at, pa.int64()), *(pa.array(p, pa.binary()) for p in parts)], names=names)

    return texts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        count, "shard int, block long, words binary, a binary, b binary, n binary, k binary, w3 binary, n3 binary")


KEPT = "kind int, block long, shard int, words binary, c binary, used binary, c3 binary"


def kept_grams(grams: DataFrame, least: int) -> DataFrame:
    """Rows of two kinds, written: 0, the answer of a shard to a block, about the block's n-grams in its order (c: count of each two-word one, 0 if it occurs less
    than ``least`` times in all; of those that stay, used: count and number of what is kept after them, c3: counts of what the block has after them, 0 likewise); 1, for
    each shard the first words of its kept n-grams with their sum (c) and number (used)."""
    names = [x.split()[0] for x in KEPT.split(", ")]

    def weigh(table):
        ends = np.cumsum([0] + [len(unpacked(x, np.int64)) for x in table.column("words").to_pylist()])
        gids = np.concatenate([np.cumsum(unpacked(x, np.int64)) for x in table.column("words").to_pylist()])
        gids, own = np.unique(gids, return_inverse=True)
        placed = lambda name: np.concatenate([own[s : e][unpacked(x, np.uint32)] for s, e, x in zip(ends, ends[1:], table.column(name).to_pylist())])
        n, k = (all_of(table.column(x), np.uint32) for x in ("n", "k"))
        sizes = np.array([int.from_bytes(x[:8], "little") // 4 for x in table.column("n").to_pylist()], np.int64)
        key, which = np.unique(placed("a") * len(gids) + placed("b"), return_inverse=True)
        c = np.bincount(which, n, len(key)).astype(np.int64)
        stays = c[which] >= least
        # what follows a history is as rare or rarer
        before = np.repeat(which, k)
        after = c[before] >= least
        before, w3, n3 = before[after], placed("w3")[after], all_of(table.column("n3"), np.uint32)[after]
        key3, which3 = np.unique(before * len(gids) + w3, return_inverse=True)
        c3 = np.bincount(which3, n3, len(key3)).astype(np.int64)
        good, front = c3 >= least, key3 // len(gids)
        used = np.bincount(front[good], c3[good], len(key)).astype(np.int64)
        number = np.bincount(front[good], minlength=len(key))
        c3 = np.where(good, c3, 0)[which3]
        both = np.stack([used, number], axis=1)
        # of each row: its two-word n-grams, and its three-word ones after those that stay
        upto = np.concatenate([[0], np.cumsum(np.where(stays, k, 0), dtype=np.int64)])
        out, stop = [], np.cumsum(sizes)
        for block, shard, e, size in zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), stop.tolist(), sizes.tolist()):
            s = slice(e - size, e)
            if stays[s].any():
                out.append((0, block, shard, None, packed(np.where(stays[s], c[which[s]], 0)), packed(both[which[s][stays[s]]].ravel()), packed(c3[upto[e - size] : upto[e]])))
        first = key[c >= least] // len(gids)
        if len(first):
            words, which1 = np.unique(first, return_inverse=True)
            out.append((1, None, None, deltas(gids[words]), packed(np.bincount(which1, c[c >= least]).astype(np.int64)), packed(np.bincount(which1)), None))
        kind, block, shard, *parts = zip(*out) if out else [()] * len(names)
        return pa.table([pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(shard, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], names=names)

    return staged(grams.groupBy("shard").applyInArrow(weigh, KEPT), "lm-kept", ["kind"])


def first_words(kept: DataFrame) -> DataFrame:
    """(gid, used, number): each word that is a history, the sum of the kept two-word n-grams it begins, and their number."""
    def read(batches):
        for b in batches:
            for i in range(b.num_rows):
                gid = np.cumsum(unpacked(b.column("words")[i].as_py(), np.int64))
                c, number = (unpacked(b.column(x)[i].as_py(), np.int64) for x in ("c", "used"))
                yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(c), pa.array(number)], names=["gid", "c", "number"])

    rows = kept.filter("kind = 1").select("words", "c", "used").mapInArrow(read, "gid long, c long, number long")
    return rows.groupBy("gid").agg(F.sum("c").alias("used"), F.sum("number").alias("number"))


def histories(counted: DataFrame, kept: DataFrame, least: int) -> DataFrame:
    """(block, id, gid, c, used, number): the words of ``counted`` as histories, nulls for those that begin nothing that is kept.

    A word that occurs less than ``least`` times begins no kept n-gram, so it is not looked up."""
    columns = ["block", "id", "gid", "c", "used", "number"]
    found = counted.filter(F.col("c") >= least).join(first_words(kept), "gid", "left").select(columns)
    none = [F.lit(None).cast("long").alias(x) for x in ("used", "number")]
    return found.union(counted.filter(F.col("c") < least).select("block", "id", "gid", "c", *none))


class Automaton:
    """The arcs and failure arcs that one block's texts can reach: arcs hold the share of the longer history, failure arcs the backoff weight.

    words: used and number of the block's words as histories; kept: the answers of the shards."""

    def __init__(self, block: Block, words, kept, all_tokens: int, distinct: int, discount: float) -> None:
        self.block, self.base, self.discount = block, all_tokens + 0.5 * (distinct + 1), discount
        at, counts = words.column("id").to_numpy(), block.c
        used, number = np.zeros(len(at)), np.zeros(len(at))
        used[at], number[at] = (pa.compute.fill_null(words.column(x), 0).to_numpy() for x in ("used", "number"))
        self.bows = 1 - (used - discount * number) / np.maximum(counts, 1)  # 1 where nothing follows
        self.c, self.c3 = np.zeros(len(block.a)), np.zeros(len(block.front))
        self.fail = np.ones(len(block.a))
        for shard, c, both, c3 in zip(*(kept.column(x).to_pylist() for x in ("shard", "c2", "both", "c3"))):
            s, e = np.searchsorted(block.shard, [shard, shard + 1])
            self.c[s:e] = unpacked(c, np.int64)
            stays = s + np.flatnonzero(self.c[s:e])
            both = unpacked(both, np.int64).reshape(-1, 2)
            self.fail[stays] = 1 - (both[:, 0] - discount * both[:, 1]) / self.c[stays]
            x, y = np.searchsorted(block.front, [s, e])
            self.c3[x + np.flatnonzero(self.c[block.front[x:y]])] = unpacked(c3, np.int64)

    def read(self) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, sum of unigram logs, sum of model logs) of each text."""
        block, code = self.block, self.block.codes
        base = ((block.c + 0.5) / self.base)[code]
        p = base.copy()
        at = np.flatnonzero(block.follows)
        p[at] *= self.bows[code[at - 1]]
        at = at[block.pair[at] >= 0]
        at = at[self.c[block.pair[at]] > 0]
        p[at] += (self.c[block.pair[at]] - self.discount) / block.c[code[at - 1]]
        fail = np.ones(len(code))
        fail[at] = self.fail[block.pair[at]]
        at = np.flatnonzero(block.ends)
        p[at] *= fail[at - 1]
        at = at[block.run[at] >= 0]
        at = at[self.c3[block.run[at]] > 0]
        p[at] += (self.c3[block.run[at]] - self.discount) / self.c[block.pair[at - 1]]
        add = lambda x: np.add.reduceat(x, block.starts)
        return block.sizes, add((block.c > 0)[code].astype(np.int64)), add(np.log10(base)), add(np.log10(p))


@settled("lm-scores")
def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", shares: tuple[float, float] | None = None,
    discount: float = 0.75, min_count: int = 2, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    The model is learned from rows where ``train`` is true.  A null text counts as the empty text, whose only token is the end.  Unseen words get the
    unigram probability of count 0.  Repeated rows are scored, and counted, each on its own.  No training rows: every word is unseen.
    An empty table gives no row.  Other columns are not read.  All words stand in n-grams; ``shares``, if given, asks for a smaller model, of words that make
    up these shares of the training tokens (two-word, three-word n-grams).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = blocks_and_counts(rows, block_chars)
    texts = blocks.filter("kind = 0").select("block", "ids", "train", "sizes", "codes")
    counted = counted_words(blocks.filter("kind = 1").select("block", "id", "word", "n"))
    total = counted.filter("once").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = total["n"], total["v"]
    floors = None if shares is None else tuple(max(1.0, n * s) for s in shares)
    bits = max(0, texts.count() * block_chars // SHARD_CHARS - 1).bit_length()
    least = max(1, min_count)
    # without floors the n-grams are counted without the counts of words
    kept = kept_grams(block_grams(texts, counted.select("block", "id", "gid", *(["c"] if floors is not None else [])), bits, floors), least)
    found = histories(counted, kept, least)
    none = lambda *kinds: [F.lit(None).cast(kind).alias(x) for x, kind in kinds]
    reach = found.select("*", *none(("shard", "int"), ("c2", "binary"), ("both", "binary"), ("c3", "binary"))).union(
        kept.filter("kind = 0").select("block", *none(("id", "int"), ("gid", "long"), ("c", "long"), ("used", "long"), ("number", "long")), "shard", "c", "used", "c3"))

    def read(key, row, parts):
        is_word = parts.column("id").is_valid()
        words, kept = parts.filter(is_word), parts.filter(pa.compute.invert(is_word))
        automaton = Automaton(Block(row, words, bits, floors), words, kept, n, v, discount)
        n_tokens, n_known, base, full = automaton.read()
        return pa.table({
            "doc_id": pa.concat_arrays([x.flatten() for x in row.column("ids").chunks]), "train": pa.concat_arrays([x.flatten() for x in row.column("train").chunks]),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(full, pa.float64())})

    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = texts.groupBy("block").cogroup(reach.groupBy("block")).applyInArrow(
        read, f"doc_id {id_type}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str = "doc_id") -> Column:
    return fold(F.col(id_col)) == 1
