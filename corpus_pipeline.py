"""Corpus pipeline over ``documents``: language ID, SimHash near-dedup, substring dedup, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last return the columns
of ``documents``.  Null texts and texts without letters leave in the first stage; empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, langid, mixing, passages, simhash
from palisade.llm.common import read, settled, small, staged

#: A document is rejected if no language of the set makes up this share of its words.
MIN_LANGUAGE_SHARE = 0.3
ROW = "__pipeline_row"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or without a main language; a null ``lang`` is filled with the predicted one."""
    model = langid.fit(langid.training_rows(docs))
    pred, score = "__pipeline_lang", "__pipeline_score"
    found = langid.identify(docs, model, out=(pred, score, "__pipeline_langs"))
    found = found.filter((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SHARE))
    return found.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate fingerprints stays: the first of the table.

    The rule is that of op6: four-word shingles, at most 4 differing bits, no check of the similarity itself.  Most pairs with a Jaccard similarity near 0.8
    differ in more bits and stay."""
    rows = simhash.with_fingerprints(docs, out="__pipeline_print").withColumn(ROW, F.monotonically_increasing_id())
    rows = staged(rows, "pipeline-prints")  # the row numbers are fixed from here on
    found = simhash.near_duplicates(rows.select(ROW, F.col("__pipeline_print").alias("fingerprint")), id_col=ROW)
    gone = staged(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(ROW)), "pipeline-copies")
    return rows.join(small(gone, 64), ROW, "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages are cut out of all texts but the first; documents left without words go."""
    kept = passages.without_repeats(docs, passages.repeats(docs))
    kept = kept.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


@settled("pipeline-contaminated")
def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(__id, __h) of the documents that hold a window of an item."""
    found = decontaminate.decontaminate(docs, items)
    return found.filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    bad = contaminated(docs, read(spark, sf_dir, "benchmark"))
    met = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h"))
    return docs.join(small(bad, 64), met, "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with size, source_size, target, taken, copies and virtual_finish (columns of these names are replaced)."""
    docs = docs.drop("size", "source_size", "target", "taken", "copies", "virtual_finish")
    rows = staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-mix")
    taken = mixing.mix(rows, carry=[ROW]).filter("taken > 0").drop("doc_id", "source")
    return rows.join(taken, ROW).drop(ROW)


STAGES = [
    ("language ID", language_id), ("SimHash near-dedup", simhash_dedup), ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination), ("mixing sources", mixing_stage),
]

#: Language models and MinHash clusters cannot be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` one after the other, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
