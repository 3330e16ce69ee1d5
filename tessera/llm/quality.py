"""Operator 1, quality classifier: supervised subword embeddings.

Every token has a hashed vector of its own, one for each of its character n-grams, and one for the pair it forms with
the token before it. A document is the average of those vectors; a softmax over a linear map of the average gives the
class. Vectors and map are learned together by stochastic gradient descent in numpy on a bounded sample of labels.

A pair whose tokens are equal is hashed as a back-reference, one feature for all words: so the model can learn what
repetition means although it has never seen the repeated word.

Because the document is an *average* and the output map is linear, the class logits of a document are the average of
the logits of its features: scoring needs one table of ``buckets x 2`` numbers (fixed size, sent with the task).

Defined results: null and empty texts have no feature and score the prior (logits 0 plus bias); repeated rows score
alike; an empty label table gives the constant score 0.5; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHE_WORDS, Words, chunks, codepoints, held_out, mix, training_rows
from tessera.runtime import ship_package

#: Labelled documents that training reads at most.
TRAIN_ROWS = 6000
#: Hash buckets of the vector table, its width, passes over the sample and the first step of descent.
BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 16, 6, 0.4
NGRAMS = (2, 3, 4)
REPEAT = 0  # the bucket of the back-reference


@dataclass
class Model:
    """``table``: logits of each feature bucket for class 0 and 1; ``bias``: the softmax bias."""

    table: np.ndarray
    bias: np.ndarray


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the words, one after the other, and where each word's begin. The first is the word itself."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    code = codepoints("".join(marked)).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(code)) - starts[owner]
    power = mix(np.arange(int(sizes.max()), dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    whole = np.add.reduceat(mix(code + np.uint64(11)) * power[place], starts)
    feats, owners = [mix(whole + np.uint64(1))], [np.arange(len(words))]
    for n in NGRAMS:
        if len(code) < n:
            continue
        inside = np.flatnonzero(owner[: len(code) - n + 1] == owner[n - 1 :])
        h = np.zeros(len(inside), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mix(code[inside + k] + np.uint64(1000 * n))
        feats.append(mix(h))
        owners.append(owner[inside])
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    ids = (np.concatenate(feats)[order] % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    return ids, np.searchsorted(who[order], np.arange(len(words)))


def pair_features(numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbouring tokens of one document."""
    a, b = numbers[:-1], numbers[1:]
    ids = (mix(hashes[a] * np.uint64(0xD6E8FEB86659FD93) + hashes[b]) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    ids[a == b] = REPEAT
    return ids


def token_hashes(words: list[str]) -> np.ndarray:
    ids, starts = word_features(words)
    return mix(ids[starts].astype(np.uint64) * np.uint64(31) + np.fromiter(map(len, words), np.uint64, len(words))) if words else np.zeros(0, np.uint64)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and their shares of all its features."""
    vocabulary = Words()
    numbers = vocabulary.numbers(text.split())
    if not len(numbers):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    words = vocabulary.fresh
    ids, starts = word_features(words)
    times = np.bincount(numbers, minlength=len(words))
    sizes = np.diff(np.append(starts, len(ids)))
    weights = np.repeat(times, sizes)
    pairs = pair_features(numbers, token_hashes(words))
    found, back = np.unique(np.concatenate([ids, pairs]), return_inverse=True)
    share = np.bincount(back, np.concatenate([weights, np.ones(len(pairs))]))
    return found.astype(np.int32), (share / share.sum()).astype(np.float32)


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    """Train on (text, label 0 or 1) by stochastic gradient descent, one document a step."""
    data = [(*document_features(t), int(y != 0)) for t, y in rows if t]
    data = [x for x in data if len(x[0])]
    if not data:
        return Model(np.zeros((BUCKETS, 2), np.float32), np.zeros(2, np.float32))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    total = EPOCHS * len(data)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            ids, share, y = data[i]
            rate = RATE * (1 - step / total)
            step += 1
            own = vectors[ids]
            mean = share @ own
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            # a feature's step follows its share of the document; the factor keeps rare features moving
            vectors[ids] = own - (rate * 20.0) * share[:, None] * back[None, :]
    return Model((vectors @ out).astype(np.float32), bias)


class Scorer:
    """Scores texts with a model; keeps per-word logits between chunks."""

    def __init__(self, model: Model) -> None:
        self.delta = (model.table[:, 1] - model.table[:, 0]).astype(np.float64)
        self.bias = float(model.bias[1] - model.bias[0])
        self.reset()

    def reset(self) -> None:
        self.words = Words()
        self.logit, self.count, self.hash = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def learn(self) -> None:
        fresh, self.words.fresh = self.words.fresh, []
        if fresh:
            ids, starts = word_features(fresh)
            self.logit = np.concatenate([self.logit, np.add.reduceat(self.delta[ids], starts)])
            self.count = np.concatenate([self.count, np.diff(np.append(starts, len(ids)))])
            self.hash = np.concatenate([self.hash, token_hashes(fresh)])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words) > CACHE_WORDS:
            self.reset()
        numbers = [self.words.numbers((t or "").split()) for t in texts]
        self.learn()
        z = np.full(len(texts), self.bias)
        for i, own in enumerate(numbers):
            if len(own):
                pairs = self.delta[pair_features(own, self.hash)]
                z[i] += (self.logit[own].sum() + pairs.sum()) / (self.count[own].sum() + len(pairs))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (probability of class 1), predicted (1 if score >= threshold)."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x 2 floats: one fixed MB

    def run(batches):
        scorer = Scorer(sent.value)
        for rest, texts in chunks(batches):
            p = scorer(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rest["doc_id"], pa.int64()), "held_out": pa.array(rest["held_out"], pa.bool_()), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32), pa.int32())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.7) -> DataFrame:
    """Learn from ``labels.quality`` and score every whole text of ``docs``."""
    return score(docs, fit(training_rows(docs, labels, "quality", train_rows)), threshold)
