"""Personal data, hard negatives and phrase collocations: against brute force, on odd input, on planted cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import collocations, negatives, sanitise

# The plain patterns of the kinds.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = [int(d) for d in match if d in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group()))


def test_entities_against_plain_patterns(spark):
    rnd = random.Random(3)
    bits = ["a", "b@", "@", ".", "_", "%", "-", "+", "1", "22", "300", " ", "(", ")", "é", "4111 1111 1111 1111", "5500-0000-0000-0004", "1.2.3.4", "x@y.z", "+49 30 1234567", "\n"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))) for i in range(1500)]
    got = {r.doc_id: r for r in sanitise.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = base_spans(text)
        assert got[i].base == want, text
        assert [got[i][f"n_{k}"] for k in sanitise.KINDS] == [want.count(f"{k}:") for k in sanitise.KINDS]
        assert got[i].spans.startswith(want)


def name_texts():
    """Mallory Quux stands near one address in five texts, and once without it; filler words stand everywhere."""
    rnd = random.Random(1)
    filler = [f"w{c}{d}" for c in "abcdefgh" for d in "mnop"]
    words = lambda n: [rnd.choice(filler) for _ in range(n)]
    rows = [(i, " ".join(words(60))) for i in range(40)]
    rows += [(100 + i, " ".join([*words(20), "Mallory", "Quux", "m.q@example.org", *words(20)])) for i in range(5)]
    return [*rows, (200, " ".join([*words(20), "said", "Mallory", "again", *words(20)]))]


def test_disclosing_terms(spark):
    rows = name_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r.doc_id: r for r in sanitise.personal_data(docs).collect()}
    for i, text in texts.items():
        terms = sorted(m.span() for m in re.finditer("Mallory|Quux", text))
        assert got[i].spans == ",".join(filter(None, [got[i].base, *(f"term:{a}:{b}" for a, b in terms)])), i
        assert bool(got[i].n_email) == (100 <= i < 105)
    # copies of one text are one context
    copies = spark.createDataFrame([(i, rows[40][1]) for i in range(50)], "doc_id long, text string").unionByName(docs.filter("doc_id < 40"))
    assert {r.spans for r in sanitise.personal_data(copies).collect() if r.doc_id < 40 and "@" not in r.spans} <= {"", got[100].base}
    assert not any("term" in r.spans for r in sanitise.personal_data(copies).collect())


def test_sanitised_texts(spark):
    rows = [*name_texts(), (300, None), (301, ""), (302, "call +1 (499) 555-6503 or 1.2.3.4, card 4111 1111 1111 1111")]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, h1 string")
    out = sanitise.sanitised(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and len(got) == len(rows)
    assert got[300] is None and got[301] == "" and got[302] == "call [PHONE] or [IP], card [CARD]"
    for i, text in rows:
        if text and i < 300:
            assert not re.search("Mallory|Quux|@", got[i])
            shown = re.sub("Mallory|Quux", "T", text.replace("m.q@example.org", "[EMAIL]"))
            assert re.sub(r"mal\*|quu\*|\[word\]|\[removed\]", "T", got[i]) == shown


def test_personal_data_of_odd_rows(spark):
    rows = [(1, None, "z"), (None, "a@b.c", "z"), (1, "a@b.c", None), (1, "a@b.c", None), (2, "", "z"), (3, "9" * 100_000, "z"), (4, "a" * 100_000, "z"), (5, "1." * 50_000 + "x", "z"), (6, "a@" + "b." * 50_000, "z"),
            (7, "+1" + "(" * 100_000, "z"), (8, "x" * 50_000 + " q@r.st " + "ö" * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sanitise.personal_data(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.spans) for r in got if r.spans and r.doc_id != 5 and r.doc_id != 6) == [(0, "email:0:5"), (1, "email:0:5"), (1, "email:0:5"), (8, "email:50001:50007")]
    assert {r.base for r in got if r.doc_id == 5} == {base_spans("1." * 50_000 + "x")} and {r.n_email for r in got if r.doc_id == 6} == {1}
    assert sanitise.personal_data(docs.limit(0)).count() == 0 and sanitise.sanitised(docs.limit(0)).count() == 0


def brute_negatives(rows, anchors, positives=5, negatives_=3):
    out = set()
    for a in anchors:
        la, va = rows[a]
        scored = sorted((-int(sum(x * y for x, y in zip(va, v))), i) for i, (_, v) in rows.items() if i != a and len(v) == len(va))
        for p, pid in [(-s, i) for s, i in scored if rows[i][0] == la][:positives]:
            fit = [(-s, i) for s, i in scored if rows[i][0] != la and 50 * p <= -100 * s <= 95 * p]
            out |= {(a, pid, rank + 1, i, p, s) for rank, (s, i) in enumerate(fit[:negatives_])}
    return out


@pytest.mark.parametrize("kind", ["clusters", "copies", "small numbers"])
def test_negatives_against_all_pairs(spark, monkeypatch, kind):
    for name, value in {"CELL_ROWS": 16, "SHARD_ROWS": 64, "QUERY_BLOCK": 7, "FIRST_ROWS": 24}.items():
        monkeypatch.setattr(negatives, name, value)
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(12, 9))
    x = centres[rnd.integers(0, 12, 700)] + rnd.normal(size=(700, 9)) * 0.2
    if kind == "copies":
        x[100:400] = x[100]
    if kind == "small numbers":
        x = rnd.integers(-2, 3, (700, 9)) / 256  # many ties, zero and negative scores
    rows = {i: (int(rnd.integers(0, 4)), [int(np.floor(256 * c)) for c in x[i]]) for i in range(700)}
    rows |= {700 + i: (i % 2, [int(c) for c in rnd.integers(-50, 50, 4)]) for i in range(30)}  # another length
    df = spark.createDataFrame([(i, label, v) for i, (label, v) in rows.items()], "vec_id long, label long, v array<long>")
    got = [tuple(r) for r in negatives.mine(df, df.filter("vec_id % 20 = 0")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, [i for i in rows if i % 20 == 0])


def test_multi_index_visits_few_cells(spark, monkeypatch):
    """On well separated clusters the bounds end a search early, and cells come by falling bounds."""
    monkeypatch.setattr(negatives, "CELL_ROWS", 16)
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(20, 8)) * 900
    x = (centres[rnd.integers(0, 20, 2000)] + rnd.normal(size=(2000, 8))).astype(int)
    df = spark.createDataFrame([(i, i % 3, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, label long, v array<long>")
    rows, index = negatives.indexed(df)
    assert rows.count() == 2000
    q = x[0].astype(float)
    order = list(index.order(q))
    assert [b for b, _, _ in order] == sorted((b for b, _, _ in order), reverse=True) and {(a, b) for _, a, b in order} == set(index.cells[8])
    found, _ = index.visits(q, 0, float(sorted(x @ x[0])[-20]), False)
    assert sum(map(len, found.values())) < len(order) / 2


def test_negatives_of_odd_rows(spark):
    vectors = spark.createDataFrame(
        [(0, [1.0, 0.5], 1, 9), (50, None, 1, 9), (1, [float("nan"), 1.0], 1, 9), (2, [1.0, None], 1, 9), (3, [float("inf"), 1.0], 1, 9), (None, [1.0, 1.0], 1, 9), (4, [0.5, 0.5], 1, 9), (4, [0.5, 0.5], 1, 9),
         (5, [0.4, 0.4], 2, 9), (6, [1.0], 1, 9), (8, [0.4, 0.4], None, 9), (100, [], 1, 9), (101, [], 2, 9), (102, [], 1, 9), (150, [0.1, 0.1], 7, 9)], "vec_id long, embedding array<double>, label int, shard int")
    rows = negatives.labelled(vectors, "vec_id", "embedding", F.col("label"))
    got = sorted(tuple(r) for r in negatives.mine(rows, rows.filter("vec_id % 50 = 0")).collect())
    v = lambda *x: [int(np.floor(256 * c)) for c in x]
    s = lambda a, b: int(np.dot(a, b))
    assert got == [(0, 4, 1, 5, s(v(1, 0.5), v(0.5, 0.5)), s(v(1, 0.5), v(0.4, 0.4))), (100, 102, 1, 101, 0, 0)]
    assert negatives.mine(rows.limit(0), rows.limit(0)).count() == 0 and negatives.mine(rows, rows.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, 1, [2**40]), (1, 1, [2**40])], "vec_id long, label long, v array<long>")
    with pytest.raises(Exception, match="may pass the range"):
        negatives.mine(huge, huge).collect()


def brute_phrases(rows, least, longest=5):
    n, f = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            lang = "und" if lang is None else lang
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, p), a in f.items():
        if len(p) == 1:
            continue
        inner = any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items())
        if not inner:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3])
def test_phrases_against_counting(spark, shards):
    rnd = random.Random(shards)
    words = ["Ab", "b", "cé", "d", "e\x1c", "ff", "g"]
    rows = []
    for _ in range(120):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r"]) for _ in range(rnd.randrange(30)))
        rows.append((text, rnd.choice(["x", "y", None])))
    rows += [("the same old story of the same old story", "y")] * 60 + [(None, "x"), ("", None), ("...,,", "x")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = collocations.collocations(df, least=6, best=10**6, shards=shards).collect()
    assert sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute_phrases(rows, 6)
    for lang in ("x", "y", "und"):
        ranked = sorted((r for r in got if r.lang == lang), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
        assert ranked == sorted(ranked, key=lambda r: (-r.score, -r.a, r.phrase.encode()))
    assert len(collocations.collocations(df, least=6, best=3, shards=shards).collect()) == sum(min(3, len([r for r in got if r.lang == x])) for x in ("x", "y", "und"))


def test_phrases_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_POWER", 3)  # a crowded table lets everything through, which the last scan removes
    monkeypatch.setattr(collocations, "MOST_POWER", 3)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 50)
    rows = [(None, None, 1), ("", "a", 1), (" . ", "a", 1), ("wort und satz " * 30_000, "a", 1), ("x" * 200_000, None, 1), ("New York New York", "", 1), ("New York New York", "", 1)]
    df = spark.createDataFrame(rows, "text string, lang string, size int")
    got = [(r.lang, r.phrase, r.a) for r in collocations.collocations(df, least=2).orderBy("lang", "rank").collect()]
    assert ("", "new york new york", 2) in got
    assert collocations.collocations(df.limit(0)).count() == 0
    assert sorted(got) == [x[:3] for x in brute_phrases([(t, lang) for t, lang, _ in rows], 2)]
