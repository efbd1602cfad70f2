"""What the n-gram model sends about a block: numbers of words, and counts alone on the way back."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from palisade.llm import lm


def test_answers_hold_counts_alone(spark, monkeypatch):
    """Shards answer in the order of the block's n-grams, so an answer needs no words: under two bytes a token here, where hashes alone took more."""
    rng, seen, stage = random.Random(5), {}, lm.staged

    def kept(df, name, *more):
        seen[name] = stage(df, name, *more)
        return seen[name]

    monkeypatch.setattr(lm, "staged", kept)
    monkeypatch.setattr(lm, "SHARD_CHARS", 20_000)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(400))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    sizes = {}

    def measured(df, name, *more):
        out = kept(df, name, *more)
        part = out.filter("kind = 0") if "kind" in out.columns else out
        binary = [c for c, t in part.dtypes if t in ("binary", "string")]
        sizes[name] = part.agg(*(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(c) for c in binary)).first().asDict() if binary else {}
        return out

    monkeypatch.setattr(lm, "staged", measured)
    got = lm.score(frame, F.lit(True), block_chars=40_000)
    n = got.agg(F.sum("n_tokens")).first()[0]
    assert n == 60 * 401
    assert sum(sizes["lm-kept"].values()) < 2 * n
    assert sum(sizes["lm-blocks"].values()) < 2 * n  # a text has more than four bytes a token


def test_rare_words_are_not_looked_up(spark, monkeypatch):
    """A word below the least count begins no kept n-gram: only the others are joined to the histories, with the same result."""
    seen, real = {}, lm.histories

    def watched(counted, kept, least):
        seen["all"] = sorted(map(tuple, counted.join(lm.first_words(kept), "gid", "left").select("block", "id", "gid", "c", "used", "number").collect()))
        out = real(counted, kept, least)
        seen["got"] = sorted(map(tuple, out.collect()))
        seen["plan"] = out._jdf.queryExecution().optimizedPlan().toString()
        return out

    monkeypatch.setattr(lm, "histories", watched)
    rows = [(i, f"same words here again once{i} same words") for i in range(8)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), F.col("doc_id") < 7, block_chars=100).collect()
    assert len(got) == 8 and seen["got"] == seen["all"]
    assert any(r[4] is not None for r in seen["got"]) and any(r[3] < 2 for r in seen["got"])
    join = seen["plan"][seen["plan"].index("Join LeftOuter"):]
    assert "c#" in join and ">= 2" in join
