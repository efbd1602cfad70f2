"""Operators that SQL cannot express against brute-force versions, and held-out accuracy of the models."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import common, decontaminate, htmltext, langid, lm, mixing, passages, quality, queries, simhash, topk, urlfilter

ACCURACY_SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def components_of(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_simhash_against_all_pairs(spark, sf, documents):
    def of(text):
        w = words(text)
        runs = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: of(t) for i, t in documents}
    near = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components_of(prints, near)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_links_of_a_dense_group_stay_few(spark):
    """All pairs of one ball are connected by a forest, and far values are not linked."""
    rng = random.Random(3)
    base = rng.getrandbits(63)
    ball = {base ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(400)}
    chain = [sum(1 << b for b in range(0, 4 * k)) for k in range(12)]
    values = sorted(ball | set(chain))
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long")).collect()
    assert len(edges) <= 24 * len(values)  # at most one edge for each shard a value comes to
    near = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 4]
    assert components_of(values, [(e.a, e.b) for e in edges]) == components_of(values, near)


def test_regions_reach_every_neighbour():
    home, start, region = simhash.regions(1)
    rng = random.Random(1)
    for v in [rng.randrange(1 << 16) for _ in range(500)]:
        own = set(region[start[v] : start[v + 1]].tolist())
        for b in range(16):
            w = v ^ (1 << b)
            other = set(region[start[w] : start[w + 1]].tolist())
            assert home[w] in own or home[v] in other


def test_topk_with_ties_and_large_values(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(6)], 1) for i in range(230)] + [(i, [1.0] * 6, 1) for i in range(300, 340)] + [(400, [1e9] * 6, 1), (401, [-1e9] * 6, 1)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, e array<double>, x int"), "vec_id", "e")
    got = defaultdict(list)
    for r in topk.top_k(v.filter("vec_id % 50 = 0"), v).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = {i: [math.floor(256 * x) for x in e] for i, e, _ in rows}
    for q in (i for i in ints if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)
        assert got[q] == [(i, -s) for s, i in scored[:5]]


def test_language_accuracy_and_mixtures(spark):
    docs = spark.read.parquet(f"{ACCURACY_SF}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    held = langid.identify(docs.filter(common.fold(F.col("doc_id")) == 0), model)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    texts = {r.lang: r.text for r in docs.filter("length(text) > 2000").groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    cut = lambda lang, n: " ".join(texts[lang].split()[:n])
    mixed = langid.infer(langid.letters(common.spaced_words(cut("de", 150) + " " + cut("es", 50))), model[1])
    share = dict(zip(model[0], mixed))
    assert share["de"] == pytest.approx(0.75, abs=0.1) and share["es"] == pytest.approx(0.25, abs=0.1) and share["en"] < 0.05
    one = langid.infer(langid.letters(common.spaced_words(cut("de", 200))), model[1])
    assert np.count_nonzero(one) == 1 and one.max() == 1


def test_url_templates_merge_and_purity(spark):
    rows = [(i, "h", f"/shop/{i}/view", True if i < 12 else None) for i in range(24)] + [(100 + i, "h", f"/news/{i}/view", False if i < 12 else None) for i in range(24)]
    rows += [(200 + i, "h", f"/blog/{i}/view", (i % 12 == 0) if i < 12 else None) for i in range(24)] + [(300 + i, "g", f"/shop/{i}", None) for i in range(9)]
    urls = spark.createDataFrame(rows, "page_id long, host string, path string, bad boolean")
    got = {r.page_id: r for r in urlfilter.judge(urls, F.col("bad")).collect()}
    assert len(got) == len(rows)
    assert got[20].template == "shop/*/*" or got[20].template == "shop/*/view"
    assert got[20].template_verdict == "block" and got[120].template_verdict == "allow" and got[305].template_verdict == "allow"
    assert got[120].purity < 0.2 < 0.8 < got[20].purity
    stats = spark.createDataFrame([("h", "a/*", 5, 50), ("h", "b/*", 6, 50), ("h", "c/*", 49, 50), ("h", "d/*", 0, 0), ("h", "*/*", 0, 0)], "host string, template string, bad long, n long")
    merged = {r.template: r.merged for r in urlfilter.merged(stats).collect()}
    assert merged["c/*"] == "c/*" and merged["d/*"] == "d/*" and merged["*/*"] == "*/*"
    alike = {r.template: r.merged for r in urlfilter.merged(stats.filter("template IN ('a/*', 'b/*')")).collect()}
    assert alike == {"a/*": "*/*", "b/*": "*/*"}


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x b a y c z"), (2, "a b c"), (3, "c one two three four five a b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    forward = decontaminate.forward_index(docs)
    found = {(r.doc_id, r.exact) for r in decontaminate.matches(forward, items, slop=2).collect()}
    assert found == {(1, False), (2, True)}
    assert {r.doc_id for r in decontaminate.matches(forward, items).collect()} == {2}


def test_lm_against_counts(spark, documents):
    """Base and model score from plain dictionaries, the model by its definition: discounted share plus backoff weight times the shorter history."""
    shares, discount, least = (1e-3, 5e-3), 0.75, 2
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(documents, "doc_id long, text string"), ~lm.held_out(), shares=shares, discount=discount, min_count=least, block_chars=40_000).collect()}
    seqs = {i: [*words(t), "\n"] for i, t in documents}
    train = [s for i, s in seqs.items() if fold(i) != 1]
    one = Counter(w for s in train for w in s)
    n, v = sum(one.values()), len(one)
    wide, narrow = ({w for w, c in one.items() if c >= max(1, n * share)} for share in shares)
    two = Counter(g for s in train for g in zip(s, s[1:]) if wide.issuperset(g))
    three = Counter(g for s in train for g in zip(s, s[1:], s[2:]) if narrow.issuperset(g))
    two, three = ({g: c for g, c in t.items() if c >= least} for t in (two, three))
    used = defaultdict(float)
    for g, c in [*two.items(), *three.items()]:
        used[g[:-1]] += c - discount
    size = lambda h: one[h[0]] if len(h) == 1 else two[h]

    def p(h, w):
        if not h:
            return (one[w] + 0.5) / (n + 0.5 * (v + 1))
        if h not in used:
            return p(h[1:], w)
        grams = two if len(h) == 1 else three
        return max(grams.get((*h, w), 0) - discount, 0) / size(h) + (1 - used[h] / size(h)) * p(h[1:], w)

    for i, s in seqs.items():
        base = sum(math.log10(p((), w)) for w in s)
        full = sum(math.log10(p(tuple(s[max(0, k - 2) : k]), w)) for k, w in enumerate(s))
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(full, rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(s), sum(one[w] > 0 for w in s), n)
    for h in [(), *list(used)[:5]]:  # a distribution over the known words and one unknown word
        assert sum(p(h, w) for w in one) + p(h, "\0") == pytest.approx(1)


HTML = {
    "<p>a<p>b": "a\n\nb", "a<br>b": "a\nb", "<ul><li>x<ul><li>y</ul><li>z</ul>": "- x\n  - y\n- z", "<ol start=9><li>x<li>y</ol>": "9. x\n10. y",
    "<div>a</div><div>b</div>": "a\nb", "x<script>if (a<b) '</p>'</script>y": "xy", "<pre>a\n  b</pre>": "a\n  b", "a &lt;b&gt; &amp;c &eacute;": "a <b> &c é",
    "<table><tr><td>aa<td>b<tr><td>c<td>dd</table>": "aa  b\nc   dd", "<table><tr><td colspan=2>wide<td>z<tr><td>abc<td>def<td>z</table>": "wide      z\nabc  def  z",
    "<p style='display:none'>no</p>yes": "yes", "<div hidden>no<p>no</div>yes": "yes", "<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>": "yes",
    "<dl><dt>t<dd>d</dl>": "t\n  d", "<h1>A</h1>text": "A\n\ntext", "<!-- <p>no --> yes": "yes", "<title>no</title><b>y</b>": "y", "<a title='x>y'>k</a>": "k", "<p": "<p", "<td>stray": "stray",
    "one\n  two   three": "one two three", "<b>a</b> <i>b</i>": "a b", "</p></div>x": "x", "<textarea> <b>k </textarea>": " <b>k", "<select><option>a<option>b</select>": "a\nb",
    "<table><tr><td><table><tr><td>in</table><td>out</table>": "in  out",
}


@pytest.mark.parametrize("page", list(HTML))
def test_html_layout(page):
    assert htmltext.visible_text(page) == HTML[page]


def test_html_never_fails_and_stays_linear():
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<ul>", "<li>", "</ul>", "<b", ">", "'", '"', "text ", "<!--", "-->", "<script>", "</script>", "&amp;", "<div style='display:none'>", "</div>", "<pre>", "\n", "<td colspan=3>", "</tr>", "<caption>"]
    for _ in range(400):
        htmltext.visible_text("".join(rng.choice(bits) for _ in range(rng.randrange(60))))
    began = time.time()
    for page in ("<div>" * 60_000, "<a '" * 60_000, "<" * 200_000, "<p>x" * 60_000, "<table><tr><td>" * 3_000, "<b>" * 30_000 + "</i>" * 30_000):
        htmltext.visible_text(page)
    assert time.time() - began < 60


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([3, 0, 1, 4])
    u, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, whole = quality.marginals(u, counts, trans)
    at, want_pairs, logs = 0, np.zeros((2, 2)), []
    for n in counts[counts > 0]:
        weight = {}
        for ys in itertools.product((0, 1), repeat=int(n)):
            weight[ys] = math.exp(sum(u[at + k] * y for k, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:])))
        z = sum(weight.values())
        logs.append(math.log(z))
        for k in range(n):
            assert good[at + k] == pytest.approx(sum(w for ys, w in weight.items() if ys[k]) / z)
        for ys, w in weight.items():
            for a, b in zip(ys, ys[1:]):
                want_pairs[a, b] += w / z
        at += n
    assert np.allclose(pairs, want_pairs) and np.allclose(sorted(whole), sorted(logs))


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{ACCURACY_SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op2_quality(spark, ACCURACY_SF).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)
    assert docs.count() == queries.op2_quality(spark, ACCURACY_SF).count()


def test_repeated_paragraphs_and_passages(spark):
    rows = {r.doc_id: r for r in queries.op4_passages(spark, ACCURACY_SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{ACCURACY_SF}/documents.parquet").collect()}
    shared, lines, by_shingle = defaultdict(set), [], defaultdict(list)
    for i, t in texts.items():
        w = t.encode().lower().split()
        for k in range(len(w) - 49):
            shared[tuple(w[k : k + 50])].add(i)
        for line in t.encode().lower().split(b"\n"):
            w = line.split()
            if len(w) >= passages.MIN_WORDS:
                lines.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    passage_docs = {i for ids in shared.values() if len({texts[i] for i in ids}) > 1 for i in ids}
    assert passage_docs and all(rows[i].repeated for i in passage_docs)
    for n, (_, s) in enumerate(lines):
        for x in s:
            by_shingle[x].append(n)
    pairs = set()
    for n, (_, s) in enumerate(lines):
        common_ = Counter(m for x in s for m in by_shingle[x] if m < n)
        pairs |= {(m, n) for m, k in common_.items() if k >= 0.8 * (len(s) + len(lines[m][1]) - k)}
    alike = {lines[k][0] for pair in pairs for k in pair}
    assert sum(rows[i].repeated for i in alike) >= 0.99 * len(alike)
    # what shares no 31 words and no similar paragraph is left alone
    short = defaultdict(set)
    for i, t in texts.items():
        w = t.encode().lower().split()
        for k in range(len(w) - passages.PASSAGE + 1):
            short[tuple(w[k : k + passages.PASSAGE])].add(i)
    touched = alike | {i for ids in short.values() if len(ids) > 1 for i in ids}
    assert not [i for i in texts if i not in touched and rows[i].repeated]


def test_repeats_are_cut_out(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = lambda n: " ".join(word() for _ in range(n))
    passage, line = own(60), own(12)
    near = line.replace(line.split()[-1], "changed")
    rows = [(1, own(20) + " " + passage + " " + own(20)), (2, own(30) + " " + passage + " " + own(5)), (3, line + "\n" + own(15)), (4, own(14) + "\n" + line), (5, own(40)), (6, near + " " + own(30)), (7, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = passages.repeats(docs)
    kept = {r.doc_id: r.text for r in passages.without_repeats(docs, spans).collect()}
    texts = dict(rows)
    assert kept[1] == texts[1] and kept[3] == texts[3] and kept[5] == texts[5] and kept[6] == texts[6]
    gone = set(passage.split()) - set(kept[2].split())
    assert len(gone) >= 60 - 2 * passages.SPAN and set(kept[2].split()) >= set(texts[2].split()) - set(passage.split())
    assert kept[4] == texts[4].split("\n")[0] and kept[7] == ""
    found = {r.doc_id: (r.repeated, list(r.keep_ids)) for r in passages.summary(docs, spans).collect()}
    assert found[2] == (True, [1]) and found[4] == (True, [3]) and found[5] == (False, []) and found[6] == (False, [])


def test_large_bands_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 3)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join([*base[:59], f"end{i}"])) for i in range(14)] + [(50, " ".join(reversed(base)))]
    spans = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {(r.doc_id, r.keep_id) for r in spans.filter("kind = 'paragraph'").collect()}
    assert kept == {(i, 0) for i in range(14)}


def test_mix_reaches_its_targets(spark):
    docs = spark.read.parquet(f"{ACCURACY_SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    total = sum(r.size for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert sum(r[0].target for r in by.values()) == pytest.approx(total)
    for source in by.values():
        assert sum(r.taken for r in source) == math.floor(source[0].target) and source[0].target <= 3 * source[0].source_size
        assert all(r.taken <= 3 * r.size for r in source)
    finish = [r.virtual_finish for r in rows]
    assert finish == sorted(finish)
    assert mixing.mix(docs.repartition(7)).collect() == rows


def test_pipeline(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.staged(stage(spark, before, "/root/testdata/sf0.001"), "test")
        if name == "SimHash near-dedup":
            found = simhash.near_duplicates(simhash.with_fingerprints(before))
            assert docs.count() == found.select("component_id").distinct().count()
            assert simhash.near_duplicates(simhash.with_fingerprints(docs)).filter("doc_id <> component_id").count() == 0
        elif name == "substring dedup":
            again = passages.summary(docs, passages.repeats(docs))
            assert again.agg(F.sum("n_removed")).first()[0] <= passages.summary(before, passages.repeats(before)).agg(F.sum("n_removed")).first()[0]
            assert docs.filter("n_chars <> length(text)").count() == 0
        elif name == "benchmark decontamination":
            items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
            bad = decontaminate.decontaminate(before, items).filter("contaminated").count()
            assert docs.count() == before.count() - bad
        elif name == "mixing sources":
            assert docs.filter("taken <= 0 OR taken > 3 * size").count() == 0
        else:
            assert docs.count() == before.filter("text rlike '[A-Za-z\\\\x{80}-\\\\x{10FFFF}]'").count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == docs.count()


def test_lm_counts_every_word(spark, documents, monkeypatch):
    """By default words of any frequency stand in n-grams, whatever the number of shards; a rare three-word run is learned."""
    monkeypatch.setattr(lm, "SHARD_CHARS", 20_000)
    rare = "qqrare zzseldom xxscarce"
    rows = [*documents, (-1, rare), (-2, rare), (-3, rare), (-4, f"qqrare xxscarce {rare}")]
    train = [*documents, (-1, rare), (-2, rare), (-4, rows[-1][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(frame, F.col("doc_id") != -3, block_chars=40_000).collect()}
    seqs = [[*words(t), "\n"] for _, t in train]
    one, two, three = (Counter(g for s in seqs for g in zip(*(s[k:] for k in range(m)))) for m in (1, 2, 3))
    n, v = sum(one.values()), len(one)
    two, three = ({g: c for g, c in t.items() if c >= 2} for t in (two, three))
    used = defaultdict(float)
    for g, c in [*two.items(), *three.items()]:
        used[g[:-1]] += c - 0.75

    def p(h, w):
        if not h:
            return (one[(w,)] + 0.5) / (n + 0.5 * (v + 1))
        if h not in used:
            return p(h[1:], w)
        size = one[h] if len(h) == 1 else two[h]
        return max((two if len(h) == 1 else three).get((*h, w), 0) - 0.75, 0) / size + (1 - used[h] / size) * p(h[1:], w)

    assert ("qqrare", "zzseldom", "xxscarce") in three
    for i, t in rows:
        s = [*words(t), "\n"]
        assert got[i].score == pytest.approx(sum(math.log10(p(tuple(s[max(0, k - 2) : k]), w)) for k, w in enumerate(s)), rel=1e-9)
    assert got[-3].score > got[-3].base_score + 6


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>T</title><p>Hello<div>more</div>", "Hello\n\nmore"), ("<head><meta charset=utf-8><style>p{}</style>\n Hello", "Hello"),
    ("<head><head><title>T</title><script>no</script><img src=x>a<b>b</b>", "ab"), ("<head><title>T</title> <link href=x> </head><body>x", "x"),
])
def test_html_content_ends_the_head(page, text):
    assert htmltext.visible_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><form><tr><td>A</td></tr></form></table>", "A"), ("<table><tr><form><td>A</td><td>B</td></form></tr></table>", "A  B"),
    ("<table><tr><td>A</td><b><td>B</td></b></tr><center><tr><td>C</td><td>D</td></tr></center></table>", "A  B\nC  D"),
])
def test_html_elements_between_cells_and_table(page, text):
    assert htmltext.visible_text(page) == text


def test_html_random_tables_lose_no_word():
    rng = random.Random(12)
    names = ["table", "tbody", "tr", "td", "th", "form", "center", "div", "a", "b", "font", "p", "ul", "li", "blockquote", "dd", "caption", "span"]
    for _ in range(3000):
        page, opened = "<table>", []
        for k in range(rng.randrange(1, 40)):
            x = rng.random()
            if x < 0.45:
                opened.append(rng.choice(names))
                page += f"<{opened[-1]}>"
            elif x < 0.7 and opened:
                page += f"</{opened.pop(rng.randrange(len(opened)))}>"
            else:
                page += f" w{k}w "
        assert sorted(re.findall(r"w\d+w", page)) == sorted(re.findall(r"w\d+w", htmltext.visible_text(page))), page


def test_short_lines_are_judged(spark):
    """Lines of 5 to 7 words and texts of as many; shorter ones on demand.  The first occurrence stays."""
    rows = [(1, "one two three four five six\nown words of the first text here"), (2, "this line is of the second\nOne two three four five six"), (3, "just four words here"),
            (4, "another long line that stands alone here\njust  four words here"), (5, "just four words"), (6, "a b c d e"), (7, "a b c d e"), (8, "a b c d f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = passages.repeats(docs, least_words=1)
    found = {r.doc_id: (r.repeated, list(r.keep_ids), r.n_removed) for r in passages.summary(docs, spans).collect()}
    assert found == {1: (True, [1], 0), 2: (True, [1], 6), 3: (True, [3], 0), 4: (True, [3], 4), 5: (False, [], 0), 6: (True, [6], 0), 7: (True, [6], 5), 8: (False, [], 0)}
    assert sorted({r.doc_id for r in passages.repeats(docs).collect()}) == [1, 2, 6, 7]


def test_equal_texts_of_short_lines(spark):
    """Copies whose lines are no paragraphs are found by their passages, also under a null id; rows that repeat are one document."""
    rng = random.Random(15)
    verse = lambda: "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4)) for _ in range(30))
    same, other, twice = verse(), verse(), verse()
    rows = [(3, same), (1, same), (2, same), (None, other), (5, other), (6, verse()), (7, twice), (7, twice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in passages.summary(docs, passages.repeats(docs)).collect()}
    assert {i for i, r in got.items() if r.repeated} == {1, 2, 3, None, 5}
    assert got[1].n_removed == 0 and got[2].n_removed > 80 and got[3].n_removed == got[2].n_removed and got[5].n_removed > 80
    assert list(got[3].keep_ids) == [1]
