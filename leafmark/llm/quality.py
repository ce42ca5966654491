"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled side is a sample of all documents, labels ignored. A logistic
model over the shape of a text and hashed n-grams of its bytes and words minimises the non-negative unbiased risk
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])
with a ridge, a stronger one on the n-grams, where the class prior is estimated from both samples: the least ratio of their upper-tail shares under a first
classifier of positives against unlabelled ones, which is fitted on one half and read on the other. Both samples are
bounded (`SAMPLE` rows each, the lowest seeded hashes); the model is fitted on the driver from their features, some
hundreds of numbers a row. Every document is scored by its whole text.

Defined results: null text counts as empty; ids in several label rows are trusted only if all say 1; without trusted
positives every score is 1; rows with a null id are scored, held out and never learnt from; an empty table gives no rows;
`keep` carries further columns, and equal rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SAMPLE = 10000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
ROUNDS = 500
RATE = 0.02
#: Buckets that trigrams of bytes are hashed into, those that words are, and those that pairs of words are.
TRIGRAMS, WORDS, PAIRS = 128, 64, 64
#: Bytes whose trigrams are counted at a time.
BLOCK = 1 << 20
#: The odd multiplier of multiplicative hashing, 2^32 by the golden ratio.
SPREAD = np.uint32(2654435769)
#: Marks whose number per word is a feature of its own: those that seldom stand in sentences, numbers and addresses.
MARKS = np.array([ord(c) for c in "!#$%&*<>[\\]^`{|}~"])


def _buckets(codes: np.ndarray, width: int, counts: np.ndarray | None = None) -> np.ndarray:
    """How many of some 32-bit codes fall into each bucket; the number of buckets is a power of two."""
    return np.bincount((codes * SPREAD) >> np.uint32(33 - width.bit_length()), weights=counts, minlength=width)


def grams(data: np.ndarray, words: list[str], counts: dict[str, int]) -> np.ndarray:
    """Shares of the hashed byte trigrams, words and word pairs of a whole text."""
    trigrams = np.zeros(TRIGRAMS)
    for at in range(0, len(data) - 2, BLOCK):
        part = data[at : at + BLOCK + 2].astype(np.uint32)
        trigrams += _buckets(part[:-2] << 16 | part[1:-1] << 8 | part[2:], TRIGRAMS)
    codes = {w: zlib.crc32(w.encode()) for w in counts}
    own = _buckets(np.fromiter(codes.values(), dtype=np.uint32, count=len(codes)), WORDS, np.fromiter(counts.values(), dtype=float, count=len(counts)))
    row = np.fromiter(map(codes.__getitem__, words), dtype=np.uint32, count=len(words))
    pairs = _buckets(row[:-1] * np.uint32(31) + row[1:], PAIRS)
    return np.concatenate([x / max(x.sum(), 1) for x in (trigrams, own, pairs)])


def features(text: str) -> np.ndarray:
    """Shape of a text (marks, capitals and repetition) and its hashed n-grams; square roots of shares."""
    words = text.split()
    n = max(len(words), 1)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    seen = np.bincount(data, minlength=256)
    letters = max(int(seen[65:91].sum() + seen[97:123].sum() + seen[192:].sum()), 1)
    repeats = sum(map(eq, words, words[1:]))
    counts = Counter(words)
    common = max(counts.values(), default=0)
    shape = [
        seen[MARKS].sum() / n,
        sum(map(str.isupper, words)) / n,
        seen[65:91].sum() / letters,
        max(0, repeats - 1) / n,
        max(0, common - 2) / n,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words) / n,
        sum(not any(map(str.isalnum, w)) for w in counts if len(w) < 4) / n,
    ]
    return np.minimum(np.sqrt(np.concatenate((shape, seen[MARKS] / n, grams(data, words, counts)))), 2)


WIDTH = len(features(""))
#: Ridge of the shape's weights and of the n-grams': many columns, each of which tells little, must not outweigh few that tell much.
SHAPE_RIDGE, GRAM_RIDGE = 1e-3, 0.1
RIDGE = np.repeat([SHAPE_RIDGE, GRAM_RIDGE], [WIDTH - TRIGRAMS - WORDS - PAIRS, TRIGRAMS + WORDS + PAIRS])


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((x - self.mean) / self.scale @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float | None) -> np.ndarray:
    """The step's direction by weights: of the non-negative risk, or without a prior of positives against unlabelled ones."""
    gp, gu = _sigmoid(p @ w), _sigmoid(u @ w)
    up = p.T @ (gp - 1) / len(p)  # logistic loss of positives as positives
    if prior is None:
        return up + u.T @ gu / len(u)
    rest = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
    down = u.T @ gu / len(u) - prior * (p.T @ gp) / len(p)
    return prior * up + down if rest >= 0 else -down


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam, with a falling rate and the ridge."""
    p, u = (np.hstack((x, np.ones((len(x), 1)))) for x in (pos, unl))
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    ridge = np.append(RIDGE, SHAPE_RIDGE)
    for t in range(1, ROUNDS + 1):
        grad = gradient(p, u, w, prior) + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - RATE * (1 - (t - 1) / ROUNDS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unlabelled scores: the least ratio of upper tails, where enough of both are left."""
    cuts = np.quantile(pos, np.linspace(0, 0.9, 91))
    tail = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    p, u = tail(pos), tail(unl)
    best = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray) -> Model:
    both = np.vstack((pos, unl))
    mean, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 0.1)  # a rare mark must not weigh more than a common one
    p, u = (pos - mean) / scale, (unl - mean) / scale
    half = lambda x, i: x[i::2] if len(x) > 1 else x
    priors = []
    for i in (0, 1):
        w, b = _fit(half(p, i), half(u, i), None)
        priors.append(estimate_prior(half(p, 1 - i) @ w + b, half(u, 1 - i) @ w + b))
    prior = sum(priors) / 2
    w, b = _fit(p, u, prior)
    return Model(w, b, mean, scale, prior)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(HELD_OUT)).cast("int")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model from two bounded samples outside the held-out fold; None without trusted positives."""
    learn = fold(F.col("id")) != HELD_OUT
    trusted = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).filter(learn & F.col("id").isNotNull())
    trusted = trusted.groupBy("id").agg(F.min(F.coalesce("y", F.lit(0))).alias("y")).filter("y = 1").select("id")
    known = docs.select(F.col(id_col).cast("long").alias("id")).filter(learn & F.col("id").isNotNull())
    order = lambda rows, seed: rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    # only labels of documents that there are; the hashes of the whole label table are compared, so the sample is full
    positives = order(trusted.join(known.distinct(), "id", "left_semi"), 1).withColumn("pos", F.lit(True))
    chosen = positives.unionByName(order(known, 2).distinct().withColumn("pos", F.lit(False))).groupBy("id").agg(F.max("pos").alias("pos"), F.min("pos").alias("only"))
    ids = chosen.select("id", "pos", (~F.col("only")).alias("unl"))
    # at most two samples of ids: bounded by the parameter
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(ids), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).astype("<f4").tobytes() for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(x, pa.binary()), b.column(2), b.column(3)], names=["id", "x", "pos", "unl"])

    found = rows.select("id", "text", "pos", "unl").mapInArrow(run, "id long, x binary, pos boolean, unl boolean").toPandas().sort_values(["id", "x"])
    x = np.frombuffer(b"".join(found["x"]), dtype="<f4").reshape(-1, WIDTH).astype(np.float64)
    pos, unl = x[found["pos"].to_numpy(dtype=bool)], x[found["unl"].to_numpy(dtype=bool)]
    return fit(pos, unl) if len(pos) and len(unl) else None


def score(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the model's score of the whole text, 0 to 1, as column `name`; one of that name is replaced."""
    if model is None:
        return docs.withColumn(name, F.lit(1.0))

    @F.arrow_udf(DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        x = [model.scores(features(t.as_py() or "")) for t in texts]
        return pa.array(x, pa.float64())

    # only the text goes to Python
    return docs.withColumn(name, scores(F.col(text_col)))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold; the columns stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    scored = score(rows, train(docs, labels, id_col, text_col))
    return scored.filter(F.col("score") >= threshold).select("row.*")
