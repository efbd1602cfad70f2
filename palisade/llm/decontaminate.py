"""Benchmark decontamination over a distributed positional index (DataFrame functions only).

Forward index: the words of every document, written once.  Inverted index: postings (term, document, position, neighbourhood) of the terms that are
the rarest in some test window.  A window is looked up by its rarest term; the position is adjusted by the term's offset in the window, and the lists of
the other terms are intersected in place, as each posting carries its neighbourhood: equal word by word is an exact phrase, all terms within
the window widened by ``slop`` a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import lower_ascii, small, staged, union_length, with_documents

WINDOW = 10
# Fixed: the characters that are no part of a word.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), _GAPS, -1), ""), F.array().cast("array<string>"))


def forward_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n_words, words) of every row, written; h tells texts of the same id apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), words_of(F.col(text_col)).alias("words"))
    return staged(rows.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), "words"), "forward")


def test_windows(items: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(w, items): distinct windows of ``width`` consecutive words, of the whole item if it has fewer, and the ids that hold them."""
    rows = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (width - 1)))
    rows = rows.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.slice("words", F.col("start"), F.lit(width)).alias("w"))
    return rows.groupBy("w").agg(F.collect_set("item_id").alias("items"))


def anchored(windows: DataFrame, forward: DataFrame) -> DataFrame:
    """The windows with ``term``, their rarest by corpus count (ties: the earlier), and ``offset``, its place in the window."""
    terms = windows.select("w", F.posexplode("w").alias("offset", "term"))
    used = staged(terms.select("term").distinct(), "terms")
    # a word of n letters takes about n + 60 bytes in a broadcast table
    counted = forward.select(F.explode("words").alias("term")).join(small(used, 128), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rated = terms.join(counted, "term", "left").select("w", "offset", "term", F.coalesce("n", F.lit(0)).alias("n"))
    return rated.groupBy("w").agg(F.min_by(F.struct("term", "offset"), F.struct("n", "offset")).alias("a")).select("w", "a.term", "a.offset")


def matches(forward: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = 0, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, start, len, items, exact): occurrences of the items' windows; start counts words from 0.

    ``exact``: the window's words follow each other there; otherwise (only with ``slop`` > 0) all of its terms occur, in any order, in the window
    widened by ``slop`` words on both sides."""
    windows = staged(test_windows(items, width, id_col, text_col), "windows")
    keyed = staged(windows.join(anchored(windows, forward), "w").select("term", "offset", "w", "items"), "anchors")
    reach = width - 1 + slop
    near = F.slice("words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
    anchors = staged(keyed.select("term").distinct(), "anchor-terms")
    postings = forward.select("doc_id", "h", "words", F.posexplode("words").alias("pos", "term")).join(small(anchors, 128), "term")
    postings = staged(postings.select("term", "doc_id", "h", "pos", near.alias("near")), "postings")
    found = postings.join(small(keyed, 128 * (width + 2)), "term").withColumns({
        "start": F.col("pos") - F.col("offset"), "first": F.greatest(F.col("pos") - reach, F.lit(0)), "len": F.size("w")})
    place = F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1
    exact = (F.col("start") >= 0) & (F.slice("near", place, F.col("len")) == F.col("w"))
    found = found.withColumn("exact", exact)
    exact = F.col("exact")
    if slop:
        low = F.greatest(F.col("start") - slop - F.col("first"), F.lit(0))
        wide = F.slice("near", low + 1, F.greatest(F.col("start") - F.col("first") - low + F.col("len") + slop, F.lit(0)))
        found = found.filter(exact | (F.size(F.array_except("w", wide)) == 0)).withColumn("start", F.greatest("start", F.lit(0)))
    else:
        found = found.filter(exact)
    return found.select("doc_id", "h", F.col("start").cast("long").alias("start"), "len", "items", "exact")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n_words, n_hit, n_items, items, contaminated), one row per row of ``docs``.

    A word is hit if it lies in an occurrence of a window; counted as the union of the occurrences, in the order of their starts.  ``items``: distinct
    ids, sorted as strings.  Null and empty texts have no words; items without words are never found; null item ids count their hits but are not listed.
    Repeated rows get the same result each; different texts of one id are told apart.  Empty tables: no rows, or no hits.
    """
    forward = forward_index(docs, id_col, text_col)
    found = staged(matches(forward, items, width).filter("exact").select("doc_id", "h", "start", "len", "items").distinct(), "matches")
    hits = union_length(found.select("doc_id", "h", "start", (F.col("start") + F.col("len")).alias("end")), "n_hit")
    listed = found.select("doc_id", "h", F.explode("items").alias("item")).groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    hits = with_documents(hits, listed)
    rows = with_documents(forward.select("doc_id", "h", "n_words"), hits)
    none = F.array().cast("array<string>")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", none)
    return rows.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), (n_hit > 0).alias("contaminated"))


DECONTAMINATE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
i AS (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS start FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[start:start + 9], ' ') AS gram FROM i),
l AS (SELECT DISTINCT size FROM w),
s AS (SELECT row, size, words, unnest(range(1, len(words) - size + 2)) AS start FROM d, l WHERE len(words) >= size),
g AS (SELECT row, size, start, array_to_string(words[start:start + size - 1], ' ') AS gram FROM s),
m AS (SELECT row, start, g.size AS size, item_id FROM g JOIN w ON w.gram = g.gram AND w.size = g.size),
p AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(start, start + size)) AS place FROM m) GROUP BY row),
n AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM m) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (row) LEFT JOIN n USING (row)
"""
