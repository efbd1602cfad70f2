"""Each frequent phrase is spelled once, however many tasks hold it; hashes that stand for several phrases are counted by words."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palisade.llm import collocations


@pytest.fixture
def texts(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice("abcdefg") for _ in range(40)), rng.choice(["x", "y"])) for _ in range(160)]
    want = Counter()
    for text, lang in rows:
        w = text.split()
        want.update((lang, " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    return spark.createDataFrame(rows, "text string, lang string").repartition(8), {k: n for k, n in want.items() if n >= 5}


def counts(df):
    rows = df.collect()
    assert len({(r.lang, r.phrase) for r in rows}) == len(rows)
    return {(r.lang, r.phrase): r.n for r in rows}


def test_spelled_rows_follow_the_phrases(texts, monkeypatch):
    df, want = texts
    seen, spelled = [], collocations.spelled
    monkeypatch.setattr(collocations, "spelled", lambda *args: seen.append(spelled(*args).persist()) or seen[-1])
    monkeypatch.setattr(collocations, "counted_phrases", None)  # not called: no hash is shared
    assert counts(collocations.frequent_phrases(df, least=5)) == want
    assert seen[0].count() == len(want)


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_shared_hashes_are_counted_by_words(texts, monkeypatch, most):
    """What a collision looks like: the spelling explains not all of the sum, or is missing."""
    df, want = texts
    spelled, odd = collocations.spelled, F.crc32("phrase") % 7
    monkeypatch.setattr(collocations, "DOUBTS", most)
    monkeypatch.setattr(collocations, "spelled", lambda *args: spelled(*args).filter(odd != 1).withColumn("c", F.when(odd == 2, F.col("c") + 1).otherwise(F.col("c"))))
    assert counts(collocations.frequent_phrases(df, least=5)) == want
