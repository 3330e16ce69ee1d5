"""Operator 7, toxicity: cumulative-link ordinal regression.

Severity has ordered grades 0 (not toxic) to 3. One weight vector over sparse text features is shared by all grades;
each threshold between neighbouring grades has its own offset: P(grade >= k) = sigmoid(w.x - b_k), b_1 < b_2 < b_3.
The result is the expected severity, the sum of P(grade >= k) over k = 1..3, and ``toxic`` where P(grade >= 1) >= ``THRESHOLD``.

Features are the lower-case words of a text and the leading 4 to 8 letters of each (so that inflected forms count
together), as log2(1 + count), and one more, how many of such features' occurrences there are in a thousand words. Kept are,
``FEATURES`` at most, those that labelled toxic texts hold more often than others, by an exact test (hypergeometric tail)
corrected for the number of features tried. The labels only say toxic or not; grades 1 to 3 are the thirds of the labelled toxic
texts by how many occurrences of such features they hold.

Defined results: null and empty texts have no feature and get the prior; without any toxic label nothing is toxic and
every severity is 0; with so few toxic labels that no feature passes the test (fewer than ``LEAST`` always, in practice about
ten) every text gets the prior, the share of toxic labels, and is toxic only if that reaches ``THRESHOLD``; an id with
conflicting labels counts as not toxic; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHE_WORDS, chunks, held_out, keep_rows, training_rows
from tessera.runtime import ship_package

#: Labelled documents that training reads at most; features kept at most; a feature's least count of texts.
TRAIN_ROWS, FEATURES, LEAST = 8000, 4000, 3
GRADES = 3
#: Chance that any feature passes the test though toxic texts hold it no more often than others; letters of the beginnings.
CHANCE, STEMS = 0.01, (4, 5, 6, 7, 8)
#: The feature of density: occurrences of all kept features in so many words.
DENSITY, PER = "#", 1000
#: A text is toxic from this probability of grade 1 or more on.
THRESHOLD = 0.35
WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    weights: dict[str, float]
    bias: np.ndarray  # ascending offsets b_1..b_GRADES


def token_features(token: str) -> list[str]:
    """The features of one white-space token: its words, and their beginnings (marked by a trailing dash)."""
    out = []
    for w in WORD.findall(token.lower()):
        out.append(w)
        out += [w[:n] + "-" for n in STEMS if len(w) >= n]
    return out


class Known(dict):
    """For each token, the number of the set of known features that it holds (mostly none: 0)."""

    def __init__(self, names: dict[str, int]) -> None:
        super().__init__()
        self.names, self.sets, self.held = names, {(): 0}, [()]

    def __missing__(self, token: str) -> int:
        own = tuple(self.names[f] for f in token_features(token) if f in self.names)
        if own not in self.sets:
            self.sets[own] = len(self.held)
            self.held.append(own)
        n = self[token] = self.sets[own]
        return n

    def counts(self, text: str) -> tuple[Counter, int]:
        """Weight of each known feature in a text (an occurrence's weight of 1 is shared by the token's features), and its tokens."""
        tokens = text.split()
        numbers = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        numbers = numbers[numbers > 0]
        found: Counter = Counter()
        if len(numbers):
            for s, n in zip(*np.unique(numbers, return_counts=True), strict=True):
                for f in self.held[s]:
                    found[f] += int(n) / len(self.held[s])
        return found, len(tokens)

    def values(self, text: str) -> dict[int, float]:
        """What each feature of the model is worth in a text; the last number is that of the density."""
        found, tokens = self.counts(text)
        out = {f: math.log2(1 + n) for f, n in found.items()}
        if found:
            out[len(self.names)] = math.log2(1 + PER * sum(found.values()) / tokens)
        return out


def tail(a: int, k: int, toxic: int, total: int) -> float:
    """Chance that at least ``a`` of ``k`` texts are toxic, if they are any of ``total`` texts of which ``toxic`` are."""

    def choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    # the terms fall fast above the mean; below it the tail is no evidence at all
    if a * total <= k * toxic:
        return 1.0
    return math.fsum(math.exp(choose(toxic, i) + choose(total - toxic, k - i) - choose(total, k)) for i in range(a, min(k, toxic) + 1) if k - i <= total - toxic)


def telling(rows: list[tuple[str, int]]) -> list[str]:
    """Features that toxic texts hold significantly more often than other texts.

    Only features of ``LEAST`` toxic texts are looked for in the others, so memory follows the toxic texts.
    """
    n = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    found: Counter = Counter()
    for text, y in rows:
        if y:
            found.update({f for token in set(text.split()) for f in token_features(token)})
    names = sorted(f for f, a in found.items() if a >= LEAST)
    known, others = Known({f: k for k, f in enumerate(names)}), np.zeros(len(names), np.int64)
    for text, y in rows:
        if not y:
            if len(known) > CACHE_WORDS:
                known = Known(known.names)
            others[list(known.counts(text)[0])] += 1
    scored = []
    for f, b in zip(names, others.tolist(), strict=True):
        a = found[f]
        # seen in toxic texts at three times the rate or more, so that words of one language only don't count
        if a * n[0] >= 3 * b * n[1]:
            p = tail(a, a + b, n[1], n[0] + n[1])
            if p * len(names) <= CHANCE:
                scored.append((p, f))
    return [f for _, f in sorted(scored)[:FEATURES]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(rows: list[tuple[str, int]], steps: int = 1000) -> Model:
    """Train on (text, toxic 0 or 1)."""
    data = [(t or "", int(y != 0)) for t, y in rows]
    if not any(y for _, y in data):
        return Model({}, np.array([50.0, 51.0, 52.0]))
    names = telling(data)
    if not names:
        warnings.warn("no feature of the labelled toxic texts passes the test: every text gets the prior", stacklevel=2)
    known = Known({f: k for k, f in enumerate(names)})
    names = [*names, DENSITY]
    row, col, val, hits = [], [], [], np.zeros(len(data))
    for i, (text, _) in enumerate(data):
        if len(known) > CACHE_WORDS:
            known = Known(known.names)
        for f, value in sorted(known.values(text).items()):
            row.append(i), col.append(f), val.append(value)
        hits[i] = sum(known.counts(text)[0].values())
    row, col, val = np.array(row, np.int64), np.array(col, np.int64), np.array(val)
    toxic = np.array([y for _, y in data], bool)
    cuts = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (hits > cuts[0]) + (hits > cuts[1]), 0)
    above = (grade[:, None] >= np.arange(1, GRADES + 1)[None, :]).astype(float)

    # offsets as b_1 and positive gaps keep their order; accelerated (Adam) steps on the cumulative-link likelihood
    theta = np.concatenate([np.zeros(len(names)), [2.0], np.zeros(GRADES - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = loss(theta, row, col, val, grade)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({f: float(x) for f, x in zip(names, theta[: len(names)], strict=True)}, offsets(theta[len(names) :]))


def offsets(raw: np.ndarray) -> np.ndarray:
    """b_1 < ... < b_GRADES from b_1 and the gaps' parameters."""
    return raw[0] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(raw[1:])))])


def loss(theta: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the grades, with a small penalty on the weights, and its gradient.

    ``theta``: weights, then b_1 and GRADES - 1 gaps; ``row``, ``col``, ``val``: the sparse features of the texts.
    """
    n, k = len(grade), len(theta) - GRADES
    w, b = theta[:k], offsets(theta[k:])
    p = sigmoid(np.bincount(row, w[col] * val, n)[:, None] - b[None, :])
    upper, lower = np.concatenate([np.ones((n, 1)), p], axis=1), np.concatenate([p, np.zeros((n, 1))], axis=1)
    every = np.arange(n)
    here = np.maximum(upper[every, grade] - lower[every, grade], 1e-9)
    slope = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
    ds = -(slope[every, grade] - slope[every, grade + 1]) / here / n
    db = np.array([(p[:, j] * (1 - p[:, j]) * ((grade == j + 1) * 1.0 - (grade == j) * 1.0) / here).sum() / n for j in range(GRADES)])
    dgap = np.array([db[j + 1 :].sum() for j in range(GRADES - 1)]) * sigmoid(theta[k + 1 :])
    return -np.log(here).mean() + 0.5e-5 * (w**2).sum(), np.concatenate([np.bincount(col, ds[row] * val, k) + 1e-5 * w, [db.sum()], dgap])


class Scorer:
    """Scores texts; remembers, for each token, the known features that it holds (mostly none)."""

    def __init__(self, model: Model) -> None:
        self.bias = model.bias
        self.names = {f: k for k, f in enumerate(f for f in model.weights if f != DENSITY)}
        self.weights = [*(model.weights[f] for f in self.names), model.weights.get(DENSITY, 0.0)]
        self.known = Known(self.names)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k) of each text, one column for each k."""
        if len(self.known) > CACHE_WORDS:
            self.known = Known(self.names)
        z = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t:
                z[i] = sum(self.weights[f] * value for f, value in self.known.values(t).items())
        return sigmoid(z[:, None] - self.bias[None, :])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, p_toxic, severity, grade, toxic of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches):
        scorer = Scorer(sent.value)
        for rest, texts in chunks(batches):
            p = scorer(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rest["doc_id"], pa.int64()), "held_out": pa.array(rest["held_out"], pa.bool_()), "p_toxic": pa.array(p[:, 0], pa.float64()), "severity": pa.array(p.sum(axis=1), pa.float64()), "grade": pa.array((p >= 0.5).sum(axis=1).astype(np.int32), pa.int32()), "toxic": pa.array(p[:, 0] >= threshold, pa.bool_())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, p_toxic double, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not toxic."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, "toxic", train_rows)))

    def make():
        scorer = Scorer(sent.value)
        return lambda texts: scorer(texts)[:, 0] < threshold

    return keep_rows(docs, make)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn from ``labels.toxic`` and score every whole text of ``docs``."""
    return score(docs, fit(training_rows(docs, labels, "toxic", train_rows)))
