"""Personal data: patterns, and terms that disclose them by co-occurrence.

Four kinds of entities are found by pattern in every whole text.  A corpus-wide estimate then says how strongly any other term reveals a protected entity: the
pointwise mutual information of term and entity against the information of the entity itself,

    PMI(t; e) / IC(e) = 1 + log(a / f) / log(N / c),

where N counts the words of the corpus outside of entities, f those that are t, c those that stand within ``REACH`` words of a mention of e, and a those that are
t and do so.  At 1, t stands nowhere but near e.  A term discloses e if this is at least ``DISCLOSURE`` and the term met e in ``CONTEXTS`` contexts of
different words, so that copies of a text count as one piece of evidence.  Disclosing terms become spans wherever they stand, also in texts that
do not name the entity.

``sanitised`` removes entities and generalises disclosing terms as little as needed: to the terms that share their first ``STEM`` letters, else to the class of
their shape, and removes them if all of these still disclose.

DataFrame functions only.  Positions come from the lengths of what lies between matches, summed up by a window within one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import LETTER_WORD, BROADCAST_BYTES, lower_ascii, settled, staged

# The kinds in their order and their patterns.  Possessive and anchored at the start of a run, they find what the plain patterns find, in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
REACH, CONTEXTS, DISCLOSURE, STEM = 10, 3, 0.9, 3
H = ["h1", "h2"]


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with h1 and h2, two hashes of the text (null: empty), which stand for it."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})


def luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def pieces(texts: DataFrame, text: Column, pattern: str) -> DataFrame:
    """(h1, h2, i, gap, match): the length before each match of a text and the match; the last gap has none."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return texts.select(*H, F.posexplode(both).alias("i", "p")).select(*H, "i", F.length("p.gap").cast("long").alias("gap"), F.col("p.match").alias("match"))


def placed(found: DataFrame, *keys: str) -> DataFrame:
    """Matches with start and end in code points."""
    order = Window.partitionBy(*H, *keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(order)
    return found.withColumn("end", end).filter(F.col("match").isNotNull()).withColumn("start", F.col("end") - F.length("match"))


def may_match() -> dict[str, Column]:
    """By kind, whether a text can hold a valid match."""
    text = F.col("text")
    return {
        "email": text.contains("@") & text.rlike(PATTERNS["email"]), "ip": text.rlike(PATTERNS["ip"]), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": text.contains("+") & text.rlike(PATTERNS["phone"]),
    }


def may_match_any() -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, may_match().values()), F.lit(False))


def entity_texts(docs: DataFrame) -> DataFrame:
    """(h1, h2, text, copies): each different text in which a pattern occurs, with the number of rows that have it."""
    found = keyed(docs.select("text").filter(may_match_any()))
    return found.groupBy(*H).agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def entity_spans(texts: DataFrame) -> DataFrame:
    """(h1, h2, kind, start, end, match) of all valid matches; kind is the place in KINDS."""
    found = [pieces(texts.filter(hit), F.col("text"), PATTERNS[k]).withColumn("kind", F.lit(i)) for i, (k, hit) in enumerate(may_match().items())]
    spans = placed(reduce(DataFrame.unionByName, found), "kind")
    ok = F.coalesce(*(F.when(F.col("kind") == i, valid(k, F.col("match"))) for i, k in enumerate(KINDS)))
    return spans.filter(ok).select(*H, "kind", "start", "end", "match")


def entity_of(kind: Column, match: Column) -> Column:
    """What is protected: the address, lower-cased, or the digits of a number."""
    return F.concat_ws(":", kind.cast("string"), F.when(kind == 0, lower_ascii(match)).when(kind == 1, match).otherwise(F.regexp_replace(match, "[^0-9]", "")))


def word_rows(texts: DataFrame) -> DataFrame:
    """(h1, h2, start, end, term) of all words."""
    return placed(pieces(texts, lower_ascii(F.col("text")), LETTER_WORD)).select(*H, "start", "end", F.col("match").alias("term"))


def free_words(texts: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words outside of all spans (h1, h2, k, term, start, end), numbered by k, and the spans (h1, h2, k, kind, start, match) with the number of words before them."""
    words = word_rows(texts).select("*", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("string").alias("match"))
    rows = words.unionByName(spans.withColumn("term", F.lit(None).cast("string")))
    is_span = F.col("kind").isNotNull()
    back = Window.partitionBy(*H).orderBy(F.desc("start"), F.desc_nulls_first("kind")).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*H).orderBy("start", F.asc_nulls_last("kind")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("next", F.min(F.when(is_span, F.col("start"))).over(back)).withColumn("last", F.max(F.when(is_span, F.col("end"))).over(on))
    free = ~is_span & (F.coalesce("next", F.col("end")) >= F.col("end")) & (F.coalesce("last", F.col("start")) <= F.col("start"))
    rows = rows.withColumn("free", free).withColumn("k", F.count(F.when(F.col("free"), 1)).over(on))
    rows = staged(rows.select(*H, "k", "term", "start", "end", "kind", "match", "free"), "pii-rows")
    return rows.filter("free").drop("kind", "match", "free"), rows.filter(is_span).drop("term", "end", "free")


def near(words: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity, term, h1, h2, k, copies, context) of the free words within REACH words of a mention; one row per mention."""
    at = mentions.withColumn("entity", entity_of(F.col("kind"), F.col("match"))).withColumn("mention", F.col("k"))
    asked = at.select(*H, "entity", "mention", "start", F.explode(F.sequence(F.col("k") - REACH + 1, F.col("k") + REACH)).alias("k")).filter("k > 0")
    met = asked.join(words.drop("start", "end"), [*H, "k"])
    around = F.sort_array(F.collect_list(F.struct((F.col("k") - F.col("mention")).alias("d"), "term", "k", "copies")))
    met = met.groupBy(*H, "entity", "mention", "start").agg(around.alias("w"))
    context = F.xxhash64(F.transform("w", lambda x: F.struct(x["d"], x["term"])))
    return staged(met.select("entity", *H, context.alias("context"), F.explode("w").alias("w")).select("entity", *H, "context", "w.k", "w.term", "w.copies"), "pii-near")


def corpus_counts(docs: DataFrame, words: DataFrame, terms: DataFrame, general=lambda term: term) -> DataFrame:
    """(term, f): how often each of the given terms stands free in the corpus; the row of a null term counts all other free words.

    ``general`` maps words to what is counted.  Texts without a pattern are split whole; ``words`` are the free words of the others."""
    plain = docs.filter(F.col("text").isNotNull() & ~may_match_any())
    plain = plain.select(F.explode(F.split(lower_ascii(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("word")).filter("word <> ''")
    n = plain.select(general(F.col("word")).alias("word"), F.lit(1).cast("long").alias("n")).unionByName(words.select(general(F.col("term")).alias("word"), F.col("copies").alias("n")))
    known = fitting(terms.select("term"))
    return n.join(known, n["word"] == known["term"], "left").groupBy("term").agg(F.sum("n").alias("f"))


def fitting(df: DataFrame) -> DataFrame:
    """Marked for broadcast if the measured bytes of its columns of text are within the bound."""
    size = df.agg(F.sum(reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"), F.lit(96)))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def ratio(a: Column, f: Column, c: Column, total: Column) -> Column:
    """PMI / IC; 1 where the entity is all there is."""
    return F.when(c >= total, F.lit(1.0)).otherwise(1 + F.log(a / f) / F.log(total / c))


def disclosing(found: DataFrame, counts: DataFrame, total: int, floor: float = DISCLOSURE) -> DataFrame:
    """(entity, term, a, f, c, ratio) of ``found`` (entity, term, a, c) where the term discloses the entity."""
    scored = found.join(counts, "term").withColumn("ratio", ratio(F.col("a"), F.col("f"), F.col("c"), F.lit(total)))
    return scored.filter(F.col("ratio") >= floor)


class Survey:
    """What a corpus (rows with text) says about its entities: their texts, spans and free words, and which terms disclose them."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs.select("text")
        self.texts = staged(entity_texts(self.docs), "pii-texts")
        self.spans = staged(entity_spans(self.texts), "pii-spans")
        words, mentions = free_words(self.texts, self.spans)
        self.words = words.join(self.texts.select(*H, "copies"), H)
        self.near = near(self.words, mentions)
        self.places = self.near.select("entity", *H, "k", "term", "copies").distinct()
        self.cover = self.places.groupBy("entity").agg(F.sum("copies").alias("c"))
        support = self.near.groupBy("entity", "term", "context", "h1").agg(F.lit(1).alias("one")).groupBy("entity", "term")
        support = support.agg(F.countDistinct("context").alias("contexts"), F.countDistinct("h1").alias("texts")).filter((F.col("contexts") >= CONTEXTS) & (F.col("texts") >= CONTEXTS))
        pairs = self.places.groupBy("entity", "term").agg(F.sum("copies").alias("a")).join(support, ["entity", "term"]).join(self.cover, "entity")
        pairs = staged(pairs.select("entity", "term", "a", "c"), "pii-pairs")
        counts = staged(corpus_counts(self.docs, self.words, pairs.select("term").distinct()), "pii-counts")
        self.total = counts.agg(F.sum("f")).first()[0] or 0
        self.terms = staged(disclosing(pairs, counts, self.total), "pii-terms")

    def term_spans(self) -> DataFrame:
        """(h1, h2, kind, start, end, match) of all free words that disclose an entity."""
        known = fitting(self.terms.select("term").distinct())
        plain = keyed(self.docs.filter(F.col("text").isNotNull() & ~may_match_any()))
        hit = plain.select(*H, F.explode(F.array_distinct(F.split(lower_ascii(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("term"))
        hit = staged(hit.join(known, "term", "left_semi").select(*H).distinct(), "pii-hit")
        texts = plain.join(fitting(hit), H, "left_semi").groupBy(*H).agg(F.min("text").alias("text"))
        words = word_rows(texts).unionByName(self.words.select(*H, "start", "end", "term"))
        return words.join(known, "term", "left_semi").select(*H, F.lit(len(KINDS)).alias("kind"), "start", "end", F.col("term").alias("match"))

    def all_spans(self) -> DataFrame:
        """(h1, h2, kind, start, end, match): entities, and terms that disclose some."""
        return self.spans if self.terms.isEmpty() else self.spans.unionByName(self.term_spans())

    def generalised(self) -> DataFrame:
        """(term, shown): each disclosing term with the most special generalisation that discloses no entity."""
        terms = self.terms.select("term").distinct()
        shown = F.lit("[removed]")
        for i, general in enumerate((shape, stem)):
            g = terms.select("term", general(F.col("term")).alias("general"))
            keys = g.select(F.col("general").alias("term")).distinct()
            counts = corpus_counts(self.docs, self.words, keys, general)
            pairs = self.places.withColumn("term", general(F.col("term"))).groupBy("entity", "term").agg(F.sum("copies").alias("a")).join(keys, "term", "left_semi").join(self.cover, "entity")
            bad = disclosing(pairs, counts, self.total).select(F.col("term").alias("general")).distinct().withColumn(f"bad{i}", F.lit(True))
            terms = terms.join(g, "term").join(bad, "general", "left").withColumnRenamed("general", f"general{i}")
            shown = F.when(F.col(f"bad{i}").isNull(), F.col(f"general{i}")).otherwise(shown)
        return terms.select("term", shown.alias("shown"))


def stem(term: Column) -> Column:
    return F.concat(F.substring(term, 1, STEM), F.lit("*"))


def shape(term: Column) -> Column:
    return F.when(term.rlike("^[0-9]+$"), "[number]").when(term.rlike("[0-9]"), "[code]").otherwise("[word]")


@settled("pii")
def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): one row for each row of ``docs`` (doc_id, text).

    ``base`` and ``spans`` list kind:start:end of the entities, and of these and disclosing terms, by kind, then start; code points, end exclusive.  Matches of one
    kind do not overlap, those of different kinds may.  Null texts are empty; equal texts have equal spans; null and repeated ids each keep their row; an
    empty table gives no row.  Other columns are ignored."""
    spans = Survey(docs).all_spans()
    one = F.struct("kind", "start", "end")
    kinds = F.array(*map(F.lit, [*KINDS, TERM]))
    name = lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])
    found = spans.groupBy(*H).agg(
        *(F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sort_array(F.collect_list(one)).alias("all"))
    found = found.withColumn("base", F.array_join(F.transform(F.filter("all", lambda x: x["kind"] < len(KINDS)), name), ",")).withColumn("spans", F.array_join(F.transform("all", name), ","))
    found = fitting(staged(found.drop("all"), "pii-found"))
    rows = keyed(docs.select("doc_id", "text")).drop("text").join(found, H, "left")
    return rows.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS), *(F.coalesce(x, F.lit("")).alias(x) for x in ("base", "spans")))


@settled("pii-sanitised")
def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with entities replaced by their kind, as [EMAIL], and disclosing terms by what they are generalised to, or [removed].

    Overlapping spans are replaced together, named by the first.  Null texts stay null; all other columns are kept."""
    survey = Survey(docs)
    spans = survey.spans.withColumn("shown", F.get(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), F.col("kind")))
    if not survey.terms.isEmpty():
        spans = spans.unionByName(survey.term_spans().join(survey.generalised().withColumnRenamed("term", "match"), "match").select(*spans.columns))
    order = Window.partitionBy(*H).orderBy("start", "kind", F.desc("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (F.coalesce(before, F.lit(-1)) <= F.col("start")).cast("int"))
    spans = spans.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy(*H, "run").agg(F.min(F.struct("start", "kind", "shown")).alias("m"), F.max("end").alias("end"))
    cuts = merged.groupBy(*H).agg(F.sort_array(F.collect_list(F.struct(F.col("m.start").alias("start"), "end", F.col("m.shown").alias("shown")))).alias("__cuts"))
    text, cut = F.col("text"), F.col("__cuts")
    since = lambda i: F.when(i > 0, F.get(cut, i - 1)["end"]).otherwise(F.lit(0).cast("long"))
    parts = F.transform(cut, lambda x, i: F.concat(F.substr(text, since(i) + 1, x["start"] - since(i)), x["shown"]))
    tail = F.substr(text, F.get(cut, F.size(cut) - 1)["end"] + 1)
    rows = docs.withColumns({"__h1": F.xxhash64(F.coalesce(text, F.lit(""))), "__h2": F.xxhash64(F.lit(1), F.coalesce(text, F.lit("")))})
    rows = rows.join(fitting(staged(cuts.toDF("__h1", "__h2", "__cuts"), "pii-cuts")), ["__h1", "__h2"], "left")
    return rows.withColumn("text", F.when(cut.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail))).select(*docs.columns)


PII_SQL = r"""
WITH u AS (SELECT coalesce(text, '') AS text, count(*) AS copies, row_number() OVER () AS h FROM documents GROUP BY coalesce(text, '')),
f AS (SELECT h, 0 AS kind, text, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m FROM u
  UNION ALL SELECT h, 1, text, string_split_regex(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM u
  UNION ALL SELECT h, 2, text, string_split_regex(text, '[0-9]([\x20-]?[0-9])+'), regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+') FROM u
  UNION ALL SELECT h, 3, text, string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM u
  UNION ALL SELECT h, 9, text, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM u),
p AS (SELECT h, kind, i, len(g[i]) AS gap, m[i] AS match FROM f, unnest(range(1, len(m) + 1)) AS x(i)),
q AS (SELECT *, (sum(gap + len(match)) OVER (PARTITION BY h, kind ORDER BY i))::BIGINT AS "end", regexp_replace(match, '[^0-9]', '', 'g') AS digits FROM p),
s AS (SELECT h, kind, "end" - len(match) AS start, "end", match FROM q WHERE kind < 4 AND CASE kind WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(match, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(try_cast('0' || ltrim(x, '0') AS INTEGER), 999) > 255)) = 0
  WHEN 2 THEN len(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, len(digits) + 1), lambda j: CASE WHEN j % 2 = 1 THEN digits[len(digits) - j + 1]::INTEGER
    WHEN digits[len(digits) - j + 1]::INTEGER > 4 THEN digits[len(digits) - j + 1]::INTEGER * 2 - 9 ELSE digits[len(digits) - j + 1]::INTEGER * 2 END)) % 10 = 0
  ELSE len(digits) BETWEEN 8 AND 15 END),
w AS (SELECT q.h, q."end" - len(match) AS start, q."end", match AS term, copies, row_number() OVER (PARTITION BY q.h ORDER BY q."end") AS k FROM q JOIN u USING (h)
  WHERE kind = 9 AND NOT EXISTS (SELECT 1 FROM s WHERE s.h = q.h AND s.start < q."end" AND s."end" > q."end" - len(match))),
e AS (SELECT s.h, s.start, kind || ':' || CASE kind WHEN 0 THEN translate(match, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 1 THEN match
    ELSE regexp_replace(match, '[^0-9]', '', 'g') END AS entity, (SELECT count(*) FROM w WHERE w.h = s.h AND w.start < s.start) AS mention FROM s),
n AS (SELECT e.entity, e.start AS at, w.*, string_agg((w.k - mention) || ':' || term, ' ') OVER (PARTITION BY e.h, e.entity, e.start, mention ORDER BY w.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS context
  FROM e JOIN w ON w.h = e.h AND w.k BETWEEN mention - 9 AND mention + 10),
o AS (SELECT DISTINCT entity, h, k, term, copies FROM n),
c AS (SELECT entity, sum(copies)::BIGINT AS c FROM o GROUP BY entity),
a AS (SELECT entity, term, sum(copies)::BIGINT AS a FROM o GROUP BY entity, term),
x AS (SELECT entity, term FROM n GROUP BY entity, term HAVING count(DISTINCT context) >= 3 AND count(DISTINCT h) >= 3),
t AS (SELECT term, sum(copies)::BIGINT AS f FROM w GROUP BY term),
z AS (SELECT sum(f)::BIGINT AS n FROM t),
d AS (SELECT DISTINCT term FROM x JOIN a USING (entity, term) JOIN c USING (entity) JOIN t USING (term), z
  WHERE CASE WHEN c >= z.n THEN 1.0 ELSE 1 + ln(a::DOUBLE / f) / ln(z.n::DOUBLE / c) END >= 0.9),
l AS (SELECT h, kind, start, "end" FROM s UNION ALL SELECT h, 4, start, "end" FROM w SEMI JOIN d USING (term)),
r AS (SELECT h, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
    string_agg(['email', 'ip', 'card', 'phone'][kind + 1] || ':' || start || ':' || "end", ',' ORDER BY kind, start) FILTER (kind < 4) AS base,
    string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || "end", ',' ORDER BY kind, start) AS spans FROM l GROUP BY h)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents y JOIN u ON u.text = coalesce(y.text, '') LEFT JOIN r USING (h)
"""
