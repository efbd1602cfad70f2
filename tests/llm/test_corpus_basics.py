"""Registered queries against their SQL, connected components, and what every operator does with odd input."""

import os
import random
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from compare import TABLES, compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from palisade.llm import common, decontaminate, htmltext, langid, lm, mixing, passages, quality, queries, simhash, topk, urlfilter  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score string, h int, size int, label int, `start` int, `end` int"


def odd_documents(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, other columns with names the operators use."""
    extra = ("x", "y", 1, 2, 3, 4, 5)
    long_text = "wort und satz " * 60_000
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 60), (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 60),
        (2, None, "en", None, None), (None, "ein kleines haus am see mit einem garten", None, "b", 9), (3, "", "de", "a", 0), (4, " \n\t ", None, "b", 4),
        (5, long_text, "de", "c", len(long_text)), (6, "!!! 12345 ...", "en", "c", 13), (7, "Ünïcödé Wörter £ 5", "de", "c", 18), (7, "other text of the same id", "en", "c", 25),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    text, _, ok = compare(spark, con, sf, name, queries.queries()[name], queries.oracle_sql()[name])
    assert ok, text


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lower_ascii_only(spark):
    got = spark.createDataFrame([("ABC",), ("ÀBC É",), (None,)], "t string").select(common.lower_ascii(F.col("t"))).collect()
    assert [r[0] for r in got] == ["abc", "Àbc É", None]


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10 and {r.source for r in rows} == {"a", "b", "c", None}
    assert sum(r.size for r in rows if r.doc_id == 1) == 26
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(none).count() == 0
    assert {r.taken for r in mixing.mix(odd.filter("doc_id IN (2, 3)")).collect()} == {0}


def test_simhash_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(simhash.with_fingerprints(odd)).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.fingerprint == 0} == {2}
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id == 1} == {(1, 1)}
    assert simhash.near_duplicates(simhash.with_fingerprints(none)).count() == 0


def test_language_of_odd_rows(odd, none):
    model = langid.fit(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == 10
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 4, 6}
    assert all(0 <= r.score <= 1 for r in rows) and {r.h for r in rows} == {1}
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "Brown fox"), (2, None), (3, ""), (None, "haus am see"), (5, "..."), (1, "brown fox")], "item_id long, text string")
    rows = {(r.doc_id, r.n_words): r for r in decontaminate.decontaminate(odd, items).collect()}
    assert decontaminate.decontaminate(odd, items).count() == 10
    fox = rows[1, 13]
    assert (fox.n_hit, fox.n_items, fox["items"], fox.contaminated) == (2, 1, ["1"], True)
    house = next(r for (i, _), r in rows.items() if i is None)
    assert (house.n_hit, house["items"]) == (3, [])
    assert rows[2, 0].n_hit == 0 and not rows[2, 0].contaminated
    assert decontaminate.decontaminate(none, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(odd, items.filter("item_id = 99")).collect())


def test_lm_of_odd_rows(odd, none):
    rows = lm.score(odd, F.lit(True)).collect()
    assert len(rows) == 10 and all(r.n_known == r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm.score(none, F.lit(True)).count() == 0
    unseen = lm.score(odd, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in unseen} == {(0, 0, 0.0)}


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, "z"), (5, 0, "z"), (5, 0, "z"), (7, None, "z"), (None, 1, "z"), (6, 0, "z"), (6, 1, "z")], "doc_id long, quality int, text string")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (2, 3)} == {0.5}
    assert quality.score(none, model).count() == 0
    unlabelled = quality.fit(odd, labels.filter("doc_id = 99"))
    assert {r.score for r in quality.score(odd, unlabelled).collect()} == {0.5}


def test_passages_of_odd_rows(odd, none):
    spans = passages.repeats(odd)
    rows = passages.summary(odd, spans).collect()
    assert len(rows) == 10
    assert not any(r.repeated for r in rows)  # repeated rows are one document
    cut = passages.without_repeats(odd, spans)
    assert cut.count() == 10 and cut.columns == odd.columns
    assert passages.summary(none, passages.repeats(none)).count() == 0


def test_urls_of_odd_rows(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (None, "no scheme", "x"), (3, "HTTP://WWW.Example.NET/en/1?q", "x"), (3, "HTTP://WWW.Example.NET/en/1?q", "x"), (4, "a://x.net", "x"), (5, "https://h.org" + "/s" * 50_000, None),
         (6, "https://notexample.com/de/1", ""), (7, "https://EXAMPLE.com/de/", "")], "page_id long, url string, host string")
    got = {r.page_id: (r.host[:20], r.rule, r.verdict) for r in urlfilter.filter_urls(pages).collect()}
    assert urlfilter.filter_urls(pages).count() == 8
    assert got[1] == ("", None, "allow") and got[None] == ("", None, "allow")
    assert got[3] == ("www.example.net", "example.net/en/", "allow")
    assert got[4] == ("x.net", None, "allow")  # an empty path does not start with /
    assert got[6] == ("notexample.com", None, "allow") and got[7][1:] == ("example.com/de/", "block")
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_html_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "t"), (None, "", "t"), (2, "<p>a", "t"), (2, "<p>a", "t"), (3, "plain < text", "t")], "page_id long, html string, text string")
    got = [(r.page_id, r.text) for r in htmltext.extract(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (None, ""), (2, "a"), (2, "a"), (3, "plain < text")], key=str)
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_vectors_of_odd_rows(spark):
    vectors = spark.createDataFrame(
        [(0, [1.0, 0.5], 1), (50, None, 1), (1, [float("nan"), 1.0], 1), (2, [1.0, None], 1), (3, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (4, [0.5, 0.5], 1), (4, [0.5, 0.5], 1),
         (5, [0.5, 0.5], 1), (6, [1.0], 1), (100, [], 1), (101, [], 1)], "vec_id long, embedding array<double>, v int")
    rows = topk.quantised(vectors, "vec_id", "embedding")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(rows.filter("vec_id % 50 = 0"), rows).collect())
    assert got == [(0, 1, 4, 256 * 128 + 128 * 128), (0, 2, 5, 256 * 128 + 128 * 128), (100, 1, 101, 0)]
    empty = topk.quantised(vectors.limit(0), "vec_id", "embedding")
    assert topk.top_k(empty, empty).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_of_odd_rows(spark, sf, odd, none, name, stage):
    got = stage(spark, odd, sf)
    if stage is corpus_pipeline.mixing_stage:
        assert {"doc_id", "text", "taken", "size"} <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    else:
        assert got.columns == odd.columns
    kept = {r.doc_id for r in got.select("doc_id").collect()}
    assert kept >= {1, 5} and kept <= {None, 1, 2, 3, 4, 5, 6, 7}
    assert stage(spark, none, sf).count() == 0
