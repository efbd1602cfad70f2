"""The operators' queries over the given tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from palisade.llm import collocations, decontaminate, htmltext, langid, lm, mixing, negatives, passages, quality, sanitise, simhash, topk, urlfilter
from palisade.llm.common import fold, read


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.training_labels(read(spark, sf_dir, "labels")))
    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.summary(docs, passages.repeats(docs))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.with_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = simhash.near_duplicates(prints.select("doc_id", "fingerprint"))
    return found.select("doc_id", simhash.hex_print(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = htmltext.extract(read(spark, sf_dir, "pages").select("page_id", "html"))
    return texts.select("page_id", "text", F.length("text").alias("n_chars"), F.size(F.split("text", "\n")).alias("n_lines"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.training_rows(docs))
    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(read(spark, sf_dir, "documents"), ~lm.held_out())
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.personal_data(read(spark, sf_dir, "documents"))
    base = F.sha2(F.col("base").cast("binary"), 256)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base.alias("base_sha256"), "spans")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.labelled(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return negatives.mine(vectors, vectors.filter("vec_id % 50 = 0"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def queries():
    return {name: fn for name, fn in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql():
    return {"op1_topk": topk.TOPK_SQL, "op3_urls": urlfilter.FILTER_SQL, "op5_decontaminate": decontaminate.DECONTAMINATE_SQL, "op8_mixing": mixing.MIX_SQL,
            "op11_pii": sanitise.PII_SQL, "op12_negatives": negatives.NEGATIVES_SQL, "op13_phrases": collocations.PHRASES_SQL}
