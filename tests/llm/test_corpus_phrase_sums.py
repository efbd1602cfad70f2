"""Phrases are summed in a task before they are handed on."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa

from palisade.llm.collocations import summed_phrases


def parts(rows):
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*row), (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "size", "phrase", "n"])


def totals(batches):
    out = Counter()
    for b in batches:
        for r in b.to_pylist():
            out[r["lang"], r["size"], r["phrase"]] += r["n"]
    return out


def test_chunks_of_a_task_share_their_rows():
    rows = [[("en", 1, "a", i), ("en", 2, "a b", 1), ("de", 1, "a", 2)] for i in range(200)]
    got = list(summed_phrases(parts(rows), rows=50))
    assert sum(b.num_rows for b in got) == 3
    assert totals(got) == totals(parts(rows))
    assert list(summed_phrases(iter([]))) == []


def test_what_does_not_shrink_is_handed_on():
    """The rows held stay bounded, by number and by bytes, and none is lost."""
    rows = [[("en", 1, f"w{i}-{j}", 1) for j in range(10)] + [("en", 1, "same", 1)] for i in range(100)]
    for limits in ({"rows": 64}, {"rows": 1 << 20, "size": 4096}):
        got = list(summed_phrases(parts(rows), **limits))
        assert totals(got) == totals(parts(rows))
        assert 1001 < sum(b.num_rows for b in got) < 1100 and max(b.num_rows for b in got) < 300
