"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad.  A line's potentials come from its own features and those of the line before and after it; a transition matrix ties
neighbouring labels.  Forward-backward marginals of the lines, weighted by length, give the document's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import fold

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_SYMBOLS = b"%$&*#@!|<>{}[]~^=_+/\\`;:"
OWN = 13
#: own features of a line, those of both neighbours, and a constant
WIDTH = 3 * OWN + 1


def own_features(line: bytes, seen: set[bytes]) -> tuple[float, ...]:
    n = len(line)
    if not n:
        return (0.0,) * (OWN - 1) + (1.0,)
    words = line.split()
    share = lambda chars: (n - len(line.translate(None, chars))) / n
    letters = share(_LETTERS)
    again = line in seen
    seen.add(line)
    count = max(1, len(words))
    return (
        np.log1p(n) / 10, letters, share(_UPPER) / max(letters, 0.01), share(_DIGITS), share(_SYMBOLS), line.count(b"|") / n * 10,
        len(set(words)) / count, (n - len(words)) / count / 10, (line.count(b".") + line.count(b",")) / count, float(line[-1:] in b".!?"),
        float(again), np.log1p(len(words)) / 10, 0.0,
    )


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x WIDTH), lengths of the lines, and the number of lines of each text; null and empty texts have none."""
    rows, sizes, counts = [], [], []
    for text in texts:
        lines = text.encode().split(b"\n") if text else []
        seen: set[bytes] = set()
        rows += [own_features(x, seen) for x in lines]
        sizes += [len(x) for x in lines]
        counts.append(len(lines))
    own, counts = np.array(rows, np.float32).reshape(-1, OWN), np.array(counts, np.int64)
    first = np.zeros(len(own), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[np.append(first[1:], True)[: len(own)]] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], axis=1), np.array(sizes, np.float64), counts


def marginals(potential: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, the expected transitions (2 x 2, summed), and the log partition function of each text.

    ``potential``: log-odds of good; all texts that still have a line are advanced together."""
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    starts, left = starts[order], counts[order]
    alpha, beta = np.zeros((len(potential), 2)), np.zeros((len(potential), 2))
    node = np.stack([np.zeros_like(potential), potential], axis=1)
    active = lambda t: int(np.searchsorted(-left, -t, side="left"))  # noqa: E731  texts with more than t lines
    longest = int(left[0]) if len(left) else 0
    for t in range(longest):
        at = starts[: active(t)] + t
        if t:
            alpha[at] = np.logaddexp(alpha[at - 1, :1] + trans[0], alpha[at - 1, 1:] + trans[1]) + node[at]
        else:
            alpha[at] = node[at]
    for t in range(longest - 2, -1, -1):
        at = starts[: active(t + 1)] + t
        ahead = node[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
    both = alpha + beta
    whole = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - whole)
    later = np.ones(len(potential), bool)
    later[starts[left > 0]] = False
    at = np.flatnonzero(later)
    pair = alpha[at - 1][:, :, None] + trans[None] + (node[at] + beta[at])[:, None, :] - whole[at][:, None, None]
    return good, np.exp(pair).sum(axis=0), whole[(np.cumsum(counts) - counts)[counts > 0]]


def train(x: np.ndarray, counts: np.ndarray, label: np.ndarray, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-4):
    """Weights, shift and scale of the features, transitions: gradient ascent (Adam) on the likelihood, the lines of a text having its label.

    Every text weighs the same, whatever its number of lines."""
    shift, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6], shift[-1] = 1, 0
    x = (x - shift) / scale
    y, weight = np.repeat(label, counts).astype(np.float64), np.repeat(1 / np.maximum(counts, 1), counts)
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    steps = np.zeros((2, 2))
    moves = np.maximum(counts - 1, 0)
    steps[0, 0], steps[1, 1] = moves[label == 0].sum(), moves[label == 1].sum()
    for i in range(rounds):
        good, pairs, _ = marginals(x @ theta[:-4], counts, theta[-4:].reshape(2, 2))
        grad = np.concatenate([x.T @ ((y - good) * weight) / len(counts), (steps - pairs).ravel() / max(1, moves.sum())]) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9 ** (i + 1))) / (np.sqrt(v / (1 - 0.99 ** (i + 1))) + 1e-8)
    return theta, shift, scale


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 4000, seed: int = 1):
    """The model, from about ``max_docs`` labelled documents at most, taken by a hash of the id; their texts are read whole.

    Ids whose label rows disagree or are null are left out; an id that repeats counts once, with its smallest text.  Without labelled lines: None and the share of
    good labels (0.5 without labels)."""
    votes = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("high"))
    votes = votes.filter("label = high AND label IN (0, 1)").filter(F.col("__id").isNotNull())
    n = votes.count()
    if n > max_docs:
        votes = votes.filter(F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))
    chosen = F.broadcast(votes.select("__id", "label"))  # about max_docs rows
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).join(chosen, F.col("__doc") == F.col("__id")).groupBy("__id", "label").agg(F.min("text").alias("text"))

    def describe(batches):
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                x, _, counts = features([text])
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array(counts), pa.array([x.tobytes()], pa.binary())], names=["label", "n", "x"])

    def learn(table):
        label, counts = table.column("label").to_numpy(), table.column("n").to_numpy()
        x = np.concatenate([np.frombuffer(v, np.float32).reshape(-1, WIDTH) for v in table.column("x").to_pylist()]).astype(np.float64)
        prior = float(label.mean())
        if not len(x):
            return pa.table({"i": pa.array([-1], pa.int32()), "value": pa.array([prior])})
        values = np.concatenate([[prior], *train(x, counts, label)])
        return pa.table({"i": pa.array(np.arange(len(values)), pa.int32()), "value": pa.array(values)})

    described = rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(describe, "label int, n long, x binary")
    found = sorted(described.groupBy().applyInArrow(learn, "i int, value double").collect())  # one number per weight
    if len(found) < 2:
        return None, (found[0]["value"] if found else 0.5)
    values = np.array([r["value"] for r in found])
    return (values[1 : WIDTH + 5], values[WIDTH + 5 : 2 * WIDTH + 5], values[2 * WIDTH + 5 :]), values[0]


def score(docs: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    """The rows with the length-weighted share of good lines, 0 to 1.

    Null texts, empty texts and texts of empty lines only have the share of good labels the model learned from.  A column named ``out`` is replaced."""
    weights, prior = model
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != out], T.StructField(out, T.DoubleType())])

    def rate(texts):
        result = np.full(len(texts), prior)
        x, sizes, counts = features(texts)
        if weights is None or not len(x):
            return result
        theta, shift, scale = weights
        good, _, _ = marginals((x - shift) / scale @ theta[:-4], counts, theta[-4:].reshape(2, 2))
        some = counts > 0
        starts = (np.cumsum(counts) - counts)[some]
        total, mass = np.add.reduceat(sizes, starts), np.add.reduceat(sizes * good, starts)
        result[some] = np.where(total > 0, mass / np.maximum(total, 1), prior)
        return np.clip(result, 0, 1)

    def add(batches):
        for b in batches:
            texts = b.column(text_col).to_pylist()
            scores = np.concatenate([rate(texts[i : i + 512]) for i in range(0, len(texts), 512)]) if texts else np.empty(0)
            kept = [n for n in b.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(scores, pa.float64())], names=[*kept, out])

    return docs.mapInArrow(add, schema)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.filter(fold(F.col(id_col)) != 0)
