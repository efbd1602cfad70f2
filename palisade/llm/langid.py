"""Language identification as inference of a mixture of languages per document.

A language is a smoothed distribution over byte n-grams inside words (with a mark at both ends), hashed into a fixed number of cells.  A document is
a bag of words, each drawn from one of a set of languages; expectation-maximisation estimates the proportions of the set, and the set grows as long as the
log-likelihood gains more than the penalty of another proportion.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import fold, pattern, spaced_words

CELLS = 1 << 15
ORDERS = (2, 3)
UNDETERMINED = "und"
_LETTER = re.compile(rb"[a-z\x80-\xff]")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every n-gram and the number of the word it lies in; n-grams do not cross words."""
    text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    space = text == 32
    word = np.cumsum(space) - 1
    found, owner = [], []
    for n in ORDERS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = (h ^ (text[i : i + m] * _MIX[i % 3])) * np.uint32(0x01000193)
        inside = ~space[1 : m + 1]  # the second byte belongs to a word
        found.append(((h ^ (h >> 15)) % CELLS).astype(np.int64)[inside])
        owner.append(word[:m][inside])
    return np.concatenate(found), np.concatenate(owner)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 20_000, smoothing: float = 0.5):
    """Languages in code-point order and their log-probabilities (languages x CELLS), from documents with a language.

    At most about ``max_docs`` documents are used: if there are more, those whose hash of id and text falls below max_docs / count; their
    texts are read whole.  The model has CELLS numbers per language whatever the input.
    """
    docs = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col, id_col)
    n = docs.count()
    if n > max_docs:
        docs = docs.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = letters(spaced_words(text))
                if words:
                    total.setdefault(lang, np.zeros(CELLS, np.int64))
                    total[lang] += np.bincount(cells(words)[0], minlength=CELLS)
        for lang, t in total.items():
            at = np.nonzero(t)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(t[at])], names=["lang", "cell", "n"])

    rows = docs.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(langs), CELLS))
    if langs:
        index = {lang: i for i, lang in enumerate(langs)}
        counts[[index[x] for x in rows.column("lang").to_pylist()], rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return langs, np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * CELLS))


def letters(words: list[bytes]) -> list[bytes]:
    """Words with a letter (A-Z, a-z or any byte beyond ASCII)."""
    has = _LETTER.search
    return [w for w in words if has(w)]


def proportions(likely: np.ndarray, rounds: int = 30, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """Mixture proportions of the columns by expectation-maximisation, and the log-likelihood; ``likely``: words x languages, logs."""
    top = likely.max(axis=1, keepdims=True)
    p = np.exp(likely - top)
    share = np.full(likely.shape[1], 1 / likely.shape[1])
    for _ in range(rounds):
        joint = p * share
        new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        moved, share = np.abs(new - share).max(), new
        if moved < close:
            break
    return share, float((np.log(p @ share) + top[:, 0]).sum())


def infer(words: list[bytes], logs: np.ndarray, penalty: float = 2.0) -> np.ndarray | None:
    """Proportion of every language; languages outside the selected set have 0.  None without words.

    Starts from the likeliest single language.  Another one joins if the log-likelihood of the enlarged set grows by more than
    ``penalty`` * log(words + 1); the one that gains most joins first.  What a language could gain at best bounds which are tried."""
    if not words or not len(logs):
        return None
    cell, owner = cells(words)
    order = np.argsort(owner, kind="stable")
    starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    likely = np.add.reduceat(logs[:, cell[order]], starts, axis=1).T
    chosen = [int(likely.sum(axis=0).argmax())]
    share, best = np.ones(1), float(likely[:, chosen[0]].sum())
    cost = penalty * np.log(len(likely) + 1)
    while len(chosen) < likely.shape[1]:
        now = likely[:, chosen].max(axis=1)
        room = {j: np.maximum(likely[:, j] - now, 0).sum() for j in range(likely.shape[1]) if j not in chosen}
        tried = [(proportions(likely[:, [*chosen, j]]), j) for j, most in room.items() if most > cost]
        if not tried:
            break
        (new, value), j = max(tried, key=lambda t: (t[0][1], -t[1]))
        if value - best <= cost:
            break
        chosen, share, best = [*chosen, j], new, value
    out = np.zeros(len(logs))
    out[chosen] = share
    return out


def identify(docs: DataFrame, model, text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "languages")) -> DataFrame:
    """The rows with ``lang_pred``, ``score`` (its proportion, 0 to 1) and ``languages`` (map of the selected set's proportions).

    ``und`` with score 0 and an empty map: null text, text without a letter, or a model without languages.  Ties go to the smaller language.
    Columns of the input with these names are replaced."""
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)  # languages x CELLS numbers
    kept = [f for f in docs.schema.fields if f.name not in out]
    schema = T.StructType([*kept, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.MapType(T.StringType(), T.DoubleType()))])
    names = [f.name for f in kept]
    letter = pattern(r"[^\W\d_]")

    def add(batches):
        logs = shared.value
        for b in batches:
            pred, score, sets = [], [], []
            for text in b.column(text_col).to_pylist():
                share = None
                if text is not None and letter.search(text):
                    share = infer(letters(spaced_words(text)), logs)
                best = -1 if share is None else int(share.argmax())
                pred.append(UNDETERMINED if best < 0 else langs[best])
                score.append(0.0 if best < 0 else min(1.0, float(share[best])))
                sets.append([] if best < 0 else [(langs[i], float(share[i])) for i in np.flatnonzero(share)])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in names], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                names=[*names, *out])

    return docs.mapInArrow(add, schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(fold(F.col(id_col)) != 0)
