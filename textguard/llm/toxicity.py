"""Toxicity: bags of subword embeddings, averaged into a linear softmax.

A word's subwords are its character n-grams (3 to 5, with a mark at either end), hashed into a
table of embeddings. Embeddings and softmax are trained jointly by gradient descent in numpy, on
the average over each labelled document. Misspelt words share most of their n-grams with the
words seen in training. As the model is linear in the average, scoring needs only one number for
each bucket. It averages over overlapping passages of a document, so that one toxic passage in a
long text is not averaged away, and counts each subword once in half a passage, so that a word
repeated all over does not make up the average; the highest passage, put through a logistic curve fitted on the
training documents, is the score.

Defined results: null, empty and letterless texts have an empty bag, whose score is the base rate
of the curve below the lowest passage; equal texts get equal scores; other columns are ignored;
without two classes among the labels the score is the share of label 1 (0 without labels).

Scale: training uses at most about ``docs_per_class`` labelled documents of each class, drawn by a
hash and weighted by the inverse of their class's share, so that a score means the same at any
size. An id that is labelled both ways counts as toxic, and of several texts of an id one is taken,
so at most 4 * ``docs_per_class`` texts, of ``most_chars`` characters together, reach the driver.
Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

_MARK = 1
_LENGTHS = (3, 4, 5)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Symbols that count as part of a word when letters or digits stand on both sides.
INNER_SYMBOLS = "*@$!|"


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point: 2 for letters and digits, 1 for inner symbols, 0 for the rest."""
    out = np.fromiter((2 * chr(i).isalnum() for i in range(0x110000)), np.uint8, 0x110000)
    out[[ord(c) for c in INNER_SYMBOLS]] = 1
    return out


def subwords(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of a text, and the number (from 0) of the word it belongs to."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    kind = np.concatenate(([0], _classes()[raw], [0])).astype(np.uint8)
    inner = kind == 2
    inner[1:-1] |= (kind[1:-1] == 1) & (kind[:-2] == 2) & (kind[2:] == 2)
    symbols = np.where(inner, np.concatenate(([_MARK], raw, [_MARK])), _MARK).astype(np.uint64)
    keep = inner.copy()
    keep[0] = True
    keep[1:] |= inner[:-1]
    symbols = symbols[keep]
    mark = symbols == _MARK
    marks = np.cumsum(mark)
    buckets, words = [], []
    for n in _LENGTHS:
        m = len(symbols) - n + 1
        if m <= 0:
            continue
        inside = marks[n - 2 : n - 2 + m] == marks[:m]  # no mark except at the ends
        first = np.flatnonzero(inside)
        h = np.full(len(first), n, np.uint64)
        for j in range(n):
            h = (h ^ symbols[first + j]) * _MULTIPLIERS[j]
            h ^= h >> np.uint64(29)
        buckets.append(((h * _MULTIPLIERS[0]) >> np.uint64(64 - bits)).astype(np.int64))
        words.append(marks[first + 1] - 1 - mark[first + 1])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(words)


def bag(text: str | None, bits: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Half-passage number and bucket of every distinct subword of each half passage, in order."""
    buckets, words = subwords(text, bits)
    pairs = np.sort((words // max(1, passage // 2)) << bits | buckets)
    if len(pairs):
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    return pairs >> bits, pairs & ((1 << bits) - 1)


@dataclass(frozen=True)
class SubwordModel:
    """weights: for each bucket the logit that its embedding adds; slope and offset of the curve."""

    weights: np.ndarray
    bits: int
    passage: int
    blanks: float
    slope: float
    offset: float

    def raw(self, text: str | None) -> float:
        """Highest average weight over passages of ``passage`` words that overlap by half; 0 for an empty bag.

        ``blanks`` subwords of weight 0 join each average, as a few subwords are weak evidence.
        """
        half, buckets = bag(text, self.bits, self.passage)
        if not len(buckets):
            return 0.0
        sums, sizes = np.bincount(half, self.weights[buckets]), np.bincount(half)
        if len(sums) > 1:
            sums, sizes = sums[1:] + sums[:-1], sizes[1:] + sizes[:-1]
        return float(np.max(sums / (sizes + self.blanks)))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(text) + self.offset, -30, 30))))


def train(texts: list[str | None], labels: np.ndarray, bits: int = 17, dims: int = 4, passage: int = 40, blanks: float = 150, least_docs: int = 5, epochs: int = 12, rate: float = 0.05, decay: float = 1e-5, seed: int = 7, shares: tuple[float, float] = (1.0, 1.0)) -> SubwordModel:
    """Fit embeddings and softmax by Adam, then the curve over the highest passages of the same documents.

    Subwords of fewer than ``least_docs`` documents keep weight 0: they could only memorise labels.
    ``shares`` are the parts of each class that were drawn; documents weigh their inverse, so that
    prior, bias and curve are those of all labelled documents.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        return SubwordModel(np.zeros(1 << bits, np.float32), bits, passage, blanks, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    bags = [np.unique(bag(text, bits, passage)[1], return_counts=True) for text in texts]
    spread = np.bincount(np.concatenate([found for found, _ in bags]), minlength=1 << bits)
    known = np.flatnonzero(spread >= least_docs)
    place = np.full(1 << bits, -1)
    place[known] = np.arange(len(known))
    bags = [(place[found[kept := place[found] >= 0]], 100 * n[kept] / max(1, n.sum())) for found, n in bags]
    table, softmax = rng.normal(0, 0.1, (len(known), dims)), rng.normal(0, 0.5, (dims, 2))
    weight = 1 / np.asarray(shares, float)[labels]
    weight *= len(weight) / weight.sum()
    bias = np.log(np.bincount(labels, weight, 2) / len(labels))
    values = [table, softmax, bias]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in values]
    batch, step = 256, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            ids = np.concatenate([bags[i][0] for i in chosen])
            shares = np.concatenate([bags[i][1] for i in chosen])
            rows = np.repeat(np.arange(len(chosen)), [len(bags[i][0]) for i in chosen])
            means = np.stack([np.bincount(rows, shares * table[ids, d], len(chosen)) for d in range(dims)], 1)
            logits = means @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = (p - np.eye(2)[labels[chosen]]) * weight[chosen, None] / len(chosen)
            pull = wrong @ softmax.T
            down = np.stack([np.bincount(ids, shares * pull[rows, d], len(known)) for d in range(dims)], 1)
            step += 1
            for value, (first, second), grad in zip(values, moments, (down + decay * table, means.T @ wrong + decay * softmax, wrong.sum(0))):
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << bits, np.float32)
    weights[known] = table @ (softmax[:, 1] - softmax[:, 0])
    model = SubwordModel(weights, bits, passage, blanks, 1.0, 0.0)
    return SubwordModel(weights, bits, passage, blanks, *_curve(np.array([model.raw(t) for t in texts]), labels, weight))


def _curve(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of the labels on one number, by Newton steps."""
    middle, spread = raw.mean(), raw.std() or 1.0
    x = np.stack([(raw - middle) / spread, np.ones(len(raw))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, x.T @ (weight * (p - labels)) + np.array([1e-2, 1e-6]) * beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * middle / spread)


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", docs_per_class: int = 2500, most_chars: int = 100_000_000, seed: int = 7, **settings) -> SubwordModel:
    """Train on about ``docs_per_class`` documents of each class (0, 1), drawn by a hash of their ids.

    Labels are drawn before they meet the texts: the drawn ones are few, whatever the corpus, so
    they are broadcast and no text but the drawn ones is shuffled.
    """
    given = labels.select(F.col(doc_id).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and key is not null")
    known = given.groupBy("key").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = {value: min(1.0, docs_per_class / n) for value, n in totals.items()}
    share = F.lit(0.0)
    for value, part in shares.items():
        share = F.when(F.col("label") == value, part).otherwise(share)
    known = known.withColumn("place", F.xxhash64(F.lit(seed), F.col("key")))
    drawn = F.pmod("place", F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(drawn < share).orderBy("place", "key").limit(4 * docs_per_class)
    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")
    one = checkpointed(rows.groupBy("key", "label", "place").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    # one row for each drawn id, so a single task orders them
    sized = Window.orderBy("place", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = one.select("key", F.sum(F.coalesce(F.char_length("text"), F.lit(0))).over(sized).alias("upto")).where(F.col("upto") <= most_chars)
    sample = one.join(F.broadcast(fitting.select("key")), "key").toPandas().sort_values(["label", "key"], kind="stable")
    return train([None if t is None else str(t) for t in sample["text"]], sample["label"].to_numpy(), seed=seed, shares=(shares.get(0, 1.0), shares.get(1, 1.0)), **settings)


def score_toxicity(text: Column, model: SubwordModel) -> Column:
    """Score (double, 0 to 1) of a text column."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)
