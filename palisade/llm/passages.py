"""Substring dedup: near-equal paragraphs by MinHash banding, and equal passages inside longer paragraphs.

Paragraphs are lines; those of fewer than SHINGLE words are compared whole.  Bands of MinHash values over their word shingles are tuned so that paragraphs at the threshold collide with the wanted recall; colliding
paragraphs are verified by the exact Jaccard similarity of their shingles and clustered by connected components.
A passage that is repeated in the middle of different lines makes no similar paragraphs.  So every text also gives anchored passages: PASSAGE words from each
position whose shingle hash is the smallest of SPAN neighbouring ones.  What any two texts share over SPAN + PASSAGE - 1 words contains a common anchored passage.
Of each cluster of paragraphs and each class of equal passages the first occurrence stays, the others are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import Forest, components, settled, spaced_words, staged, union_length, with_documents
from palisade.llm.simhash import SEED, shingle_hashes

SHINGLE = 5
SPAN, PASSAGE = 20, 31
#: Paragraphs with fewer words have no shingle: they are judged, where ``least_words`` asks for it, by equality of the whole line.
MIN_WORDS = SHINGLE
#: Equal lines below this length are common by chance and counted apart.
LONG_LINE = 8
#: Paragraphs of one band that one task compares with each other or with as many others.
BLOCK = 4000


def tune_bands(threshold: float, recall: float = 0.99, rows: int = 2) -> int:
    """Number of bands of ``rows`` values so that a pair at the threshold collides with at least the recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def paragraphs(words_of_lines: list[list[bytes]], least_words: int) -> list[tuple[int, int]]:
    ends = np.cumsum([len(w) for w in words_of_lines]).tolist()
    return [(e - len(w), e) for w, e in zip(words_of_lines, ends) if len(w) >= max(1, least_words)]


def anchors(prints: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the anchored passages: leftmost smallest hash in each run of SPAN starts."""
    m = n_words - PASSAGE + 1
    if m < SPAN:
        return np.empty(0, np.int64)
    found = []
    for i in range(0, m - SPAN + 1, 1 << 15):
        part = np.lib.stride_tricks.sliding_window_view(prints[i : min(m, i + (1 << 15) + SPAN - 1)], SPAN)
        found.append(np.arange(i, i + len(part)) + part.argmin(axis=1))
    return np.unique(np.concatenate(found))


def units(text: str, bands: int, rows: int, least_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, int, list[int] | None]]:
    """(kind, key, start, end, bands) of a text: 0, paragraphs; 1, anchored passages.  Spans count words; keys are hashes of the lower-cased words."""
    lines = [line.split() for line in text.encode().lower().split(b"\n")]
    words = [w for line in lines for w in line]
    if not words:
        return
    prints = shingle_hashes(words, SHINGLE)
    joined, offset = b" ".join(words), np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
    key = lambda s, e: xxhash.xxh64_intdigest(joined[offset[s] : offset[e] - 1], SEED)
    spans = []
    for s, e in paragraphs(lines, least_words):
        if e - s < MIN_WORDS:
            yield 0, key(s, e), s, e, []
        else:
            spans.append((s, e))
    if spans:
        rng = np.random.default_rng(11)
        mixes = rng.integers(1, 1 << 63, (2, bands * rows, 1), dtype=np.uint64) | np.uint64(1)
        cuts = np.array([(s, e - SHINGLE + 1) for s, e in spans]).ravel()
        least = np.empty((bands * rows, len(spans)), np.uint64)
        padded = np.append(prints, np.uint64(0))
        for k in range(bands * rows):
            least[k] = np.minimum.reduceat((padded ^ mixes[0, k]) * mixes[1, k], cuts)[::2]
        band = least.reshape(bands, rows, -1)
        mixed = np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            mixed = (mixed ^ (band[:, r] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = mixed.view(np.int64).T.tolist()
        for (s, e), b in zip(spans, mixed):
            yield 0, key(s, e), s, e, b
    last = None
    for s in anchors(prints, len(words)).tolist():
        k = key(s, s + PASSAGE)
        if last and last[1] == k:  # a text that repeats itself: one passage up to its last repetition
            last = (1, k, last[2], s + PASSAGE, None)
        else:
            if last:
                yield last
            last = (1, k, s, s + PASSAGE, None)
    if last:
        yield last


def all_units(docs: DataFrame, bands: int, rows: int, least_words: int) -> DataFrame:
    """The units of every (doc_id, h, text), written: kind, key, doc_id, h, start, end, bands."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["kind", "key", "doc_id", "h", "start", "end", "bands"]

    def cut(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 256):
                found = [(j, *u) for j, t in enumerate(texts[i : i + 256], i) if t for u in units(t, bands, rows, least_words)]
                if not found:
                    continue
                at, kind, key, start, end, band = zip(*found)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64)), b.column("doc_id").take(at), b.column("h").take(at),
                     pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(band, pa.list_(pa.int64()))], names=names)

    schema = f"kind int, key long, doc_id {id_type}, h long, start int, end int, bands array<long>"
    return staged(docs.select("doc_id", "h", "text").mapInArrow(cut, schema), "units", ["kind"])


def place() -> Column:
    return F.struct("doc_id", "h", "start")


def paragraph_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, line): the lower-cased words of each wanted paragraph (key, doc_id, h, start, end), fetched from its text."""
    per_doc = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "start", "end")).alias("spans"))
    per_doc = staged(per_doc, "wanted").withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    # a large share of all texts is wanted, so the table of spans grows with the corpus: a shuffle join at every size
    met = docs.join(per_doc, docs["doc_id"].eqNullSafe(F.col("__id")) & (docs["h"] == F.col("__h"))).select("text", "spans")

    def take(batches):
        for b in batches:
            keys, lines = [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words = spaced_words(text)
                keys += [s["key"] for s in spans]
                lines += [b" ".join(words[s["start"] : s["end"]]).decode() for s in spans]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.string())], names=["key", "line"])

    # rows that repeat give the same line again
    return met.mapInArrow(take, "key long, line string").dropDuplicates(["key"])


def verified_links(groups: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) of a spanning forest of the pairs of each band's paragraphs whose shingle sets have at least the Jaccard similarity.

    ``groups``: band, i, j, own (block of the row), key, line.  Pairs that are connected already need no comparison."""
    def shingles(line):
        words = line.split(" ")
        return {tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}

    def verify(table):
        own, keys = np.array(table.column("own").to_pylist()), table.column("key").to_pylist()
        sets = [shingles(x) for x in table.column("line").to_pylist()]
        order = sorted(range(len(keys)), key=lambda k: (len(sets[k]), keys[k]))
        one_block = table.column("i")[0] == table.column("j")[0]
        trees, a, b, first = Forest(len(keys)), [], [], 0
        for n, k in enumerate(order):
            while len(sets[order[first]]) < threshold * len(sets[k]):  # smaller sets cannot reach the threshold
                first += 1
            for other in reversed(order[first:n]):
                if not one_block and own[k] == own[other] or trees.root(k) == trees.root(other):
                    continue
                common = len(sets[k] & sets[other])
                if common >= threshold * (len(sets[k]) + len(sets[other]) - common):
                    trees.join(k, other)
                    a.append(keys[k])
                    b.append(keys[other])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return groups.groupBy("band", "i", "j").applyInArrow(verify, "a long, b long")


def repeating(rows: DataFrame, name: str, also: DataFrame | None = None) -> DataFrame:
    """The rows whose key occurs twice, or is one of ``also`` (key), as most keys occur once.  Keys that do grow with the corpus, so the join is the same at every size."""
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    keys = staged(keys if also is None else keys.union(also).distinct(), f"{name}-twice")
    return staged(rows.join(keys, "key", "left_semi"), f"{name}-rows")


def near_paragraphs(docs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """(node, component) over the keys of paragraphs that are similar to another one."""
    banded = lines.select("key", F.explode("bands").alias("band"))
    twice = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    banded = staged(banded.join(staged(twice, "bands-twice"), "band", "left_semi"), "bands-some")
    met = banded.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("band")
    met = staged(met, "bands-met")
    pairs = staged(banded.join(met, "band").distinct(), "band-members")
    sizes = pairs.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    wanted = lines.join(pairs.select("key").distinct(), "key").groupBy("key").agg(F.min_by(F.struct("doc_id", "h", "start", "end"), place()).alias("at"))
    texts = paragraph_texts(docs, wanted.select("key", "at.*"))
    rows = pairs.join(sizes, "band").join(texts, "key").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "line")
    return components(verified_links(rows, threshold))


@settled("repeats")
def repeats(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, band_rows: int = 2, id_col: str = "doc_id", text_col: str = "text", least_words: int = MIN_WORDS,
) -> DataFrame:
    """(doc_id, h, start, end, kind, keep_id, kept): every occurrence of a repeated paragraph or passage, as a span of words.

    ``keep_id``: the document whose occurrence stays, the smallest by id, text hash and position (null ids first); ``kept``: whether this is it.
    ``least_words``: words of the shortest lines that are judged as paragraphs; 1 for all lines, those without a shingle by equality.
    h is the hash of the text; rows that repeat id and text are one document.  Null and empty texts have no units.  An empty table gives no row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    found = all_units(docs, tune_bands(threshold, recall, band_rows), band_rows, least_words)
    lines = found.filter("kind = 0").select("key", "doc_id", "h", "start", "end", "bands")
    passages = found.filter("kind = 1").select("key", "doc_id", "h", "start", "end")

    near = staged(near_paragraphs(docs, lines, threshold), "near")
    lines = repeating(lines.drop("bands"), "line", near.select(F.col("node").alias("key")))
    classes = lines.groupBy("key").agg(F.min(place()).alias("first"), F.max(place()).alias("last"))
    classes = staged(classes.join(near.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("root", F.coalesce("component", "key")).select("key", "root", "first", "last"), "classes")
    roots = classes.groupBy("root").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first <> last")
    line_keys = staged(classes.join(roots.select("root", F.col("first").alias("keep")), "root").select("key", "keep"), "line-keys")

    passages = repeating(passages, "passage")
    # a passage has to occur in two documents, which differ in text or id (a null id differs from others); equal texts have equal passages
    again = passages.groupBy("key").agg(
        F.min("h").alias("low"), F.max("h").alias("high"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("doc_id").alias("named"), F.count(F.lit(1)).alias("all"))
    again = again.filter("low <> high OR least <> most OR (named > 0 AND named < all)").select("key")
    again = staged(again, "passage-keys")
    many = passages.join(again, "key")
    keeps = many.groupBy("key").agg(F.min(place()).alias("keep"))
    keeps = staged(keeps, "passage-keeps")

    def occurrences(rows, keys, kind):
        rows = rows.select("key", "doc_id", "h", "start", "end").join(keys, "key")
        kept = (F.col("keep.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("keep.h") == F.col("h")) & (F.col("keep.start") == F.col("start"))
        return rows.select("doc_id", "h", "start", "end", F.lit(kind).alias("kind"), F.col("keep.doc_id").alias("keep_id"), kept.alias("kept"))

    spans = occurrences(lines, line_keys, "paragraph").union(occurrences(passages, keeps, "passage"))
    return spans.distinct()


def summary(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_repeated (passages, and paragraphs of at least LONG_LINE words, that occur elsewhere too), n_short (shorter lines that
    do), n_removed (words to remove), keep_ids (sorted ids of the documents where the occurrence that stays lies), repeated (any of these)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"))
    short = F.col("end") - F.col("start") < LONG_LINE
    found = spans.groupBy("doc_id", "h").agg(F.count(F.when(~short, 1)).alias("n_repeated"), F.count(F.when(short, 1)).alias("n_short"), F.array_sort(F.collect_set("keep_id")).alias("keep_ids"))
    found = with_documents(found, union_length(spans.filter("NOT kept"), "n_removed"))
    rows = with_documents(rows, found)
    none = F.array().cast(spans.select(F.array("keep_id").alias("x")).schema["x"].dataType)
    return rows.select(
        "doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_repeated", "n_short")), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("keep_ids", none).alias("keep_ids"), F.col("n_repeated").isNotNull().alias("repeated"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the spans that are not kept cut out of their texts; lines that lose all words go, other spacing stays."""
    cuts = spans.filter("NOT kept").groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("__cuts"))
    rows = docs.withColumns({"__doc": F.col(id_col), "__text": F.xxhash64(F.col(text_col))})
    cuts = cuts.withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    rows = rows.join(cuts, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h")), "left").drop("__doc", "__text", "__id", "__h")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__cuts"])

    def cut(text, spans):
        places = [m.span() for m in _WORD.finditer(text)]
        drop = np.zeros(len(text), bool)
        for s in spans:
            drop[places[s["start"]][0] : places[s["end"] - 1][1]] = True
        kept, at = [], 0
        for line in text.split("\n"):
            flags = drop[at : at + len(line)]
            at += len(line) + 1
            if flags.any():
                line = "".join(c for c, f in zip(line, flags) if not f)
                if not line.strip(" \t\r\f\v"):
                    continue
            kept.append(line)
        return "\n".join(kept)

    def add(batches):
        for b in batches:
            spans = b.column("__cuts").to_pylist()
            texts = [cut(t, s) if s else t for t, s in zip(b.column(text_col).to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if f == text_col else b.column(f) for f in schema.names], names=schema.names)

    return rows.mapInArrow(add, schema)
