"""Phrase collocations by dynamic itemset counting.

The documents are dealt into ``SHARDS`` shards, which are scanned in turn, again and again.  Single words are counted from the first scan on.  Between two scans, a
longer phrase becomes active once both its subphrases, without its last and without its first word, have reached the threshold in what has been counted so
far; so phrases of several lengths are counted in one scan.  Every phrase is counted for one full cycle from its activation on, and the scans end when no
active phrase is left open.

Scans count 64-bit hashes of phrases over texts that are encoded once.  What has reached the threshold is kept in a table of ``slots`` of bounded size that
holds, for two places of each hash, the scan after which the place was first taken.  Places that are shared by chance make a phrase active early, which costs
time but no count, as it still gets one full cycle.  The scans also add up a second hash of each occurrence and keep one chunk that holds the phrase.  At the end
each frequent phrase is spelled once, from that chunk; where its second hash does not account for the whole sum, the hash stands for several phrases, and these
are counted by their words in one more scan.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import is_small, settled, small, staged

#: Scans of a full cycle; words of the longest phrase.
SHARDS, LONGEST = 4, 5
#: Bytes of text to one slot of the table of reached phrases, and its sizes as powers of two: a full one only lets more phrases through.
SLOT_BYTES, LEAST_POWER, MOST_POWER = 32, 16, 26
#: Text that is encoded together, and hashes of a task that are summed before they are handed on.
CHUNK_BYTES, SUM_ROWS = 1 << 20, 4 << 20
#: Rows and bytes of counted phrases that a task sums before it hands them on.
PHRASE_ROWS, PHRASE_BYTES = 1 << 20, 64 << 20
#: Second hashes are smaller than this; hashes of several phrases that are counted by words on their own, at most.
CHECKS, DOUBTS = 1 << 31, 1 << 20
#: The characters between pieces, and the lower case of A-Z.
BETWEEN = b".,;:!?\n\x0b\x0c\r"
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BETWEEN, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(BETWEEN))
UNDETERMINED = "und"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, with b"." between pieces."""
    return text.translate(FOLDED).replace(b".", b" . ").split()


def encoded(texts: list[bytes], lang: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, the first being b"."; their hashes, which differ by language; word number of every token)."""
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    known[b"."]
    ids = np.array([known[w] for w in words_of(b".".join(texts))], np.int64)
    seed = xxhash.xxh64_intdigest(lang.encode())
    return list(known), np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in known), np.uint64, len(known)), ids


def grown(front: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their front and of their last word."""
    x = front * np.uint64(0x9E3779B97F4A7C15) + last
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def checks_of(words: list[bytes], lang: str) -> np.ndarray:
    """Second hashes of words."""
    seed = xxhash.xxh32_intdigest(lang.encode(), 1)
    return np.fromiter((xxhash.xxh32_intdigest(w, seed) for w in words), np.uint32, len(words))


def check_of(second: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Second hashes of the phrases of ``size`` tokens that start at ``at``, from those of all tokens."""
    x = second[at].astype(np.uint64)
    for i in range(1, size):
        x = x * np.uint64(0xD6E8FEB86659FD93) + second[at + i]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(33)).astype(np.int64)


def reach(h: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The scan from which each hash counts as frequent, 0 if it does not."""
    power = len(slots).bit_length() - 1
    a, b = slots[(h & np.uint64(len(slots) - 1)).astype(np.int64)], slots[(h >> np.uint64(64 - power)).astype(np.int64)]
    return np.where((a > 0) & (b > 0), np.maximum(a, b), 0).astype(np.uint8)


def phrase_levels(one: np.ndarray, slots: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, starts, hashes, since) of the phrases of two words on whose subphrases have both been reached, ``since`` being when.

    ``one``: hashes of all tokens, 0 between pieces."""
    h, r = one, np.where(one > 0, reach(one, slots), 0)
    for size in range(2, longest + 1):
        at = np.nonzero((r[:-1] > 0) & (r[1:] > 0))[0]
        if not len(at):
            return
        found, since = grown(h[at], one[at + size - 1]), np.maximum(r[at], r[at + 1])
        yield size, at, found, since
        h, r, reached = np.zeros(len(r) - 1, np.uint64), np.zeros(len(r) - 1, np.uint8), reach(found, slots)
        # places that are shared may be older than the phrase is active; it counts as reached when it is active, or what follows lacks part of its cycle
        h[at], r[at] = found, np.where(reached > 0, np.maximum(reached, since), 0)


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of a batch by language, in chunks of about CHUNK_BYTES."""
    texts, rows = batch.column("text").cast(pa.binary()), defaultdict(list)
    for i, lang in enumerate(batch.column("lang").to_pylist()):
        rows[lang].append(i)
    for lang, places in rows.items():
        part, size = [], 0
        for i in places:
            part.append(texts[i].as_py())
            size += len(part[-1])
            if size >= CHUNK_BYTES:
                yield lang, part
                part, size = [], 0
        if part:
            yield lang, part


def encoded_chunks(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, chunk, lang, hashes, checks, ids, words, n): the texts as word numbers, hashes and spelling of words, dealt to shards; n words in all."""

    def encode(batches):
        at, chunk = TaskContext.get().partitionId(), TaskContext.get().partitionId() << 32
        for b in batches:
            for lang, texts in by_lang(b):
                words, h, ids = encoded(texts, lang)
                h[0] = 0
                n = int((ids > 0).sum())
                packed = ids.astype(np.uint16 if len(h) <= 1 << 16 else np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at % shards], pa.int32()), pa.array([chunk]), pa.array([lang]), pa.array([h.tobytes()]), pa.array([checks_of(words, lang).tobytes()]), pa.array([packed]),
                     pa.array([b" ".join(words)]), pa.array([n], pa.int64())], names=["shard", "chunk", "lang", "hashes", "checks", "ids", "words", "n"])
                at, chunk = at + 1, chunk + 1

    return staged(docs.mapInArrow(encode, "shard int, chunk long, lang string, hashes binary, checks binary, ids binary, words binary, n long"), "encoded", ["shard"])


def tokens_of(hashes: np.ndarray, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.uint16 if len(hashes) <= 1 << 16 else np.uint32)


def summed(h: np.ndarray, since: np.ndarray, n: np.ndarray, s: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((since, h))
    h, since, n, s, chunk = h[order], since[order], n[order], s[order], chunk[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (since[1:] != since[:-1])
    at = np.nonzero(first)[0]
    return h[at], since[at], np.add.reduceat(n, at), np.add.reduceat(s, at) % CHECKS, np.minimum.reduceat(chunk, at)


COUNTS = "h long, since int, n long, s long, chunk long"


def added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h", "since").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("chunk").alias("chunk"))


def scan(chunks: DataFrame, step: int, shards: int, slots: Broadcast, longest: int) -> DataFrame:
    """(h, since, n, s, chunk) of what is active in scan ``step`` of its shard: s is the sum of the second hashes of all n, chunk the first that has it."""

    def count(batches):
        table, kept, size = slots.value, [], 0
        names = [x.split()[0] for x in COUNTS.split(", ")]

        def sums():
            h, since, n, s, chunk = summed(*(np.concatenate(x) for x in zip(*kept)))
            for i in range(0, len(h), 1 << 18):
                j = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(h[j].view(np.int64)), pa.array(since[j].astype(np.int32)), pa.array(n[j]), pa.array(s[j]), pa.array(chunk[j])], names=names)

        for b in batches:
            for chunk, hashes, checks, ids in zip(b.column("chunk").to_pylist(), b.column("hashes"), b.column("checks"), b.column("ids")):
                h, second = np.frombuffer(hashes.as_py(), np.uint64), np.frombuffer(checks.as_py(), np.uint32)
                tokens = tokens_of(h, ids.as_py())
                new, second = [], (second, second[tokens])
                if step < shards and len(tokens):
                    n = np.bincount(tokens, minlength=len(h)).astype(np.int64)[1:]
                    new.append((h[1:], np.zeros(len(n), np.uint8), n, n * check_of(second[0], np.arange(1, len(h)), 1)))
                for k, at, found, since in phrase_levels(h[tokens], table, longest):
                    open_ = np.nonzero(since.astype(np.int64) + shards > step)[0]
                    found, first, which, n = np.unique(found[open_], return_index=True, return_inverse=True, return_counts=True)
                    s = np.bincount(which, check_of(second[1], at[open_], k), len(n)).astype(np.int64)  # below 2^53 in a chunk
                    new.append((found, since[open_][first], n.astype(np.int64), s))
                kept += [(*x, np.full(len(x[0]), chunk)) for x in new if len(x[0])]
                size += sum(len(x[0]) for x in new)
                if size >= SUM_ROWS:
                    yield from sums()
                    kept, size = [], 0
        if kept:
            yield from sums()

    rows = chunks.filter(F.col("shard") == step % shards).select("chunk", "hashes", "checks", "ids")
    return added(rows.mapInArrow(count, COUNTS))


def taken(slots: np.ndarray, reached: DataFrame, step: int) -> None:
    """Enter hashes that reached the threshold; places are or-ed into words of 64 bits in Spark before they come to the driver."""
    power = len(slots).bit_length() - 1
    place = F.explode(F.array(F.col("h").bitwiseAND(len(slots) - 1), F.shiftrightunsigned("h", 64 - power)))
    rows = reached.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    bits = rows.column("bits").to_numpy().view(np.uint64)
    for k in range(64):
        at = (rows.column("at").to_numpy()[(bits >> np.uint64(k) & np.uint64(1)) > 0] << 6) + k
        at = at[slots[at] == 0]
        slots[at] = step


def summed_phrases(parts: Iterator[pa.RecordBatch], rows: int = PHRASE_ROWS, size: int = PHRASE_BYTES) -> Iterator[pa.RecordBatch]:
    """Counts of phrases (lang, size, phrase, n), those of equal phrases added up as long as the sums stay within half of ``rows`` and ``size`` bytes."""
    kept, n, used = [], 0, 0

    def sums() -> pa.Table:
        table = pa.Table.from_batches(kept)
        return table.group_by(["lang", "size", "phrase"], use_threads=False).aggregate([("n", "sum")]).select(["lang", "size", "phrase", "n_sum"]).rename_columns(table.column_names)

    for part in parts:
        kept.append(part)
        n, used = n + part.num_rows, used + part.nbytes
        if n >= rows or used >= size:
            table = sums()
            n, used = table.num_rows, table.nbytes
            kept = table.to_batches(max_chunksize=1 << 16)
            if 2 * n >= rows or 2 * used >= size:
                yield from kept
                kept, n, used = [], 0, 0
    if kept:
        yield from sums().to_batches(max_chunksize=1 << 16)


def spelled(chunks: DataFrame, frequent: DataFrame, slots: Broadcast, longest: int) -> DataFrame:
    """(h, since, lang, size, phrase, c): what each hash stands for in the chunk that is named for it, and the second hash."""

    def spell(batches):
        table, names = slots.value, ["h", "since", "lang", "size", "phrase", "c"]
        for b in batches:
            for lang, hashes, checks, ids, words, wanted in zip(*(b.column(x) for x in ("lang", "hashes", "checks", "ids", "words", "wanted"))):
                h, second = np.frombuffer(hashes.as_py(), np.uint64), np.frombuffer(checks.as_py(), np.uint32)
                tokens = tokens_of(h, ids.as_py()).astype(np.int64)
                one, second = h[tokens], second[tokens]
                wanted = wanted.values.to_numpy().view(np.uint64)
                spelling = pa.array(words.as_py().split(b" "), pa.binary())
                at = np.nonzero(tokens)[0]
                for size, at, found, since in [(1, at, one[at], np.zeros(len(at), np.uint8)), *phrase_levels(one, table, longest)]:
                    found, first = np.unique(found, return_index=True)
                    good = np.isin(found, wanted)
                    at, since, found = at[first[good]], since[first[good]], found[good]
                    if len(at):
                        parts = [spelling.take(pa.array(tokens[at + k])) for k in range(size)]
                        phrases = (pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]).cast(pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(found.view(np.int64)), pa.array(since.astype(np.int32)), pa.array([lang.as_py()] * len(at), pa.string()), pa.array(np.full(len(at), size, np.int32)), phrases,
                             pa.array(check_of(second, at, size))], names=names)

    wanted = frequent.groupBy("chunk").agg(F.collect_list("h").alias("wanted"))
    wanted = F.broadcast(wanted) if is_small(frequent, 16) else wanted
    rows = chunks.select("chunk", "lang", "hashes", "checks", "ids", "words").join(wanted, "chunk").drop("chunk")
    return rows.mapInArrow(spell, "h long, since int, lang string, size int, phrase string, c long")


def exact_counts(docs: DataFrame, chunks: DataFrame, frequent: DataFrame, slots: Broadcast, least: int, longest: int) -> DataFrame:
    """(lang, size, phrase, n) of the frequent hashes (h, since, n, s, chunk).  Hashes that do not stand for one phrase alone are counted anew, by words."""
    both = staged(frequent.join(spelled(chunks, frequent, slots, longest), ["h", "since"], "left"), "spelled")
    alone = F.coalesce(F.pmod(F.pmod("n", F.lit(CHECKS)) * F.col("c"), F.lit(CHECKS)) == F.pmod("s", F.lit(CHECKS)), F.lit(False))
    doubtful = both.filter(~alone).select("h").distinct()
    doubts = [r.h for r in doubtful.limit(DOUBTS + 1).collect()] if not both.filter(~alone).isEmpty() else []
    if not doubts:
        return both.select("lang", "size", "phrase", "n")
    if len(doubts) > DOUBTS:
        return counted_phrases(docs, slots, least, longest)
    only = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(doubts, np.int64).view(np.uint64)))
    return both.join(doubtful, "h", "left_anti").select("lang", "size", "phrase", "n").union(counted_phrases(docs, slots, least, longest, only))


def counted_phrases(docs: DataFrame, slots: Broadcast, least: int, longest: int, only: Broadcast | None = None) -> DataFrame:
    """(lang, size, phrase, n) of the phrases in the table that occur ``least`` times, by their words; ``only``: of those with these hashes."""

    def count(batches):
        table = slots.value
        for b in batches:
            for lang, texts in by_lang(b):
                known, h, ids = encoded(texts, lang)
                spelled = pa.array(known, pa.binary())
                one = np.where(ids > 0, h[ids], 0)
                sizes = [(1, np.nonzero(ids > 0)[0], one[ids > 0], None), *phrase_levels(one, table, longest)]
                rank = ids
                for size, at, found, _ in sizes:
                    good = reach(found, table) > 0
                    at = at[good]
                    if not len(at):
                        break
                    key = rank[at] if size == 1 else rank[at] * len(known) + ids[at + size - 1]
                    _, first, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    rank = np.zeros(len(ids), np.int64)
                    rank[at] = which
                    if only is not None:
                        keep = np.isin(found[good][first], only.value)
                        first, n = first[keep], n[keep]
                    parts = [spelled.take(pa.array(ids[at[first] + k])) for k in range(size)]
                    phrases = (pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), size, np.int32)), phrases, pa.array(n, pa.int64())], names=["lang", "size", "phrase", "n"])

    rows = docs.mapInArrow(lambda batches: summed_phrases(count(batches)), "lang string, size int, phrase string, n long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


@settled("phrases")
def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, size, phrase, n, words): all phrases of up to ``longest`` words with n >= ``least`` occurrences in their language, and the number of all words of it.

    ``docs``: text, lang; a null lang counts as 'und', null texts have no words.  A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at spaces and
    tabs.  Phrases lie within pieces and may overlap.  Rows that repeat count each time.  Other columns are ignored; an empty table gives no row."""
    texts = docs.filter(F.col("text").isNotNull()).select(F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"), "text")
    chunks = encoded_chunks(texts, shards)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    spark, step = docs.sparkSession, 0
    slots = np.zeros(1 << min(MOST_POWER, max(LEAST_POWER, (size // SLOT_BYTES).bit_length())), np.uint8)
    state, closed = spark.createDataFrame([], COUNTS), []
    while True:
        shared = spark.sparkContext.broadcast(slots)
        found = added(state.unionByName(scan(chunks, step, shards, shared, longest)))
        found = staged(found.filter((F.col("since") + shards - 1 > step) | (F.col("n") >= least)), "counts")
        shared.destroy()
        reached = found.filter(F.col("n") >= least)
        taken(slots, reached, step + 1)
        state = found.filter(F.col("since") + shards - 1 > step)
        closed.append(reached.filter(F.col("since") + shards - 1 == step))
        step += 1
        if step >= shards and slots.max(initial=0) <= step - shards:
            break
    shared = spark.sparkContext.broadcast(slots)
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("words"))
    frequent = staged(functools.reduce(DataFrame.unionByName, closed), "frequent")
    return exact_counts(texts, chunks, frequent, shared, least, longest).join(small(totals, 256), "lang").select("lang", "size", "phrase", "n", "words")


def collocations(docs: DataFrame, least: int = 100, best: int = 2000, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of each language of 2 to ``longest`` words that occur ``least`` times or more.

    Cutting a phrase in two gives the counts l and r of its parts and the score floor(1000 * a * n / (l * r)); the cut of the lowest score counts, ties to the
    earliest.  A phrase that lies in a longer candidate as frequent as itself is dropped.  Ranks go by score, then a, then phrase in byte order.  See
    ``frequent_phrases`` for odd input."""
    found = frequent_phrases(docs, least, longest, shards)
    counts = found.select("lang", "phrase", "n")
    candidates = found.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.col("words").alias("n"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    cut = cut.join(counts.toDF("lang", "first", "l"), ["lang", "first"]).join(counts.toDF("lang", "rest", "r"), ["lang", "rest"])
    exact = F.expr("(1000 * cast(a as decimal(19,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cut = cut.withColumn("score", exact)
    lowest = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "n", "m.score", "m.l", "m.r")
    inner = candidates.filter("size > 2").select("lang", "size", F.split("phrase", " ").alias("w"), F.col("a").alias("longer"))
    inner = inner.withColumn("len", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("at", F.explode(F.expr("sequence(1, size - len + 1)")))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("len")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, s.size, array_to_string(w[i : i + s.size - 1], ' ') AS phrase
  FROM w, (VALUES (1), (2), (3), (4), (5)) s(size), unnest(range(1, len(w) - s.size + 2)) AS u(i)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.lang, f.size, f.phrase, string_split(f.phrase, ' ') AS w, f.n AS a, t.n FROM f JOIN t USING (lang) WHERE size > 1),
k AS (SELECT c.*, k, x.n AS l, y.n AS r, ((1000::HUGEINT * a * c.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM c, unnest(range(1, size)) AS u(k), f x, f y
  WHERE x.lang = c.lang AND y.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ') AND y.phrase = array_to_string(c.w[k + 1 : ], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND y.size > x.size AND 100 * y.a >= 100 * x.a
  AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b ANTI JOIN d ON b.lang = d.lang AND b.phrase = d.phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
