"""Operator 3, language identification by hyperdimensional profiles.

Every letter, of any script, owns a random vector of +1 and -1; those of the commonest ``LETTERS`` are held ready, the
others are made by a seeded hash of the code point when they come. An n-gram's vector binds its letters: the vector of the letter at place
p is rotated p times and the rotated vectors are multiplied element by element. A text bundles (adds) the vectors of
its n-grams; a language's prototype bundles the texts of that language. A text gets the language whose prototype has
the largest cosine with it, after the mean of all prototypes, which says nothing about a language, is taken off both.

Every text with a letter gets a language. Whether it is in that language at all is a second answer, ``known``: its n-grams
have, on average, at least ``SHARE`` of the projection on the language's (uncentred) prototype that the n-grams of the language's
training texts have in the median, each training text against the prototype of the others. The average over n n-grams varies
by about the median over the root of n, so ``SLACK`` times that is allowed; very short texts are known. Noise and languages
that were not learned project far less.

Defined results: ``und`` with score 0, not known, where the text is null or has no letter, or where no language was learned; a
tie goes to the first language by name; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, codepoints, held_out, keep_rows, within
from tessera.runtime import ship_package

#: Texts that training reads at most (smallest id hashes first).
TRAIN_ROWS = 4000
#: Width of the vectors, letters in an n-gram, letters whose vectors are held ready (the commonest), and other ones that are remembered.
DIM, N, LETTERS, REMEMBERED = 1024, 3, 120, 8192
#: n-gram vectors that are made at a time, and texts that are bundled at a time.
SLICE, TEXTS = 4096, 256
#: Part of the median projection of a language's training texts that a text of the language has at least, and the medians by which
#: one n-gram alone may fall below.
SHARE, SLACK = 0.45, 2.5
#: The gap's symbol, bits of a symbol, code points, and the seed of the vectors.
GAP, BITS, POINTS, SEED = 0, 21, 0x110000, 20240229


@dataclass
class Model:
    languages: list[str]
    alphabet: list[int]  # code points, commonest first
    centre: np.ndarray  # DIM
    prototypes: np.ndarray  # languages x DIM, centred and of length 1
    own: np.ndarray  # languages x DIM, not centred, of length 1
    median: np.ndarray  # languages: the median of the average projection of an n-gram on ``own``


class LetterVectors:
    """The fixed random vectors of symbols; the same on every worker.

    The first ``count`` symbols have rows of one table; a symbol ``count + c`` is the letter of code point c.
    """

    def __init__(self, count: int) -> None:
        self.table = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (count, DIM))
        self.made: dict[int, np.ndarray] = {}

    def __getitem__(self, symbols) -> np.ndarray:
        symbols = np.asarray(symbols)
        if not symbols.ndim:
            return self.table[symbols] if symbols < len(self.table) else self.other(int(symbols) - len(self.table))
        out = self.table[np.where(symbols < len(self.table), symbols, 0)]
        for at in np.flatnonzero(symbols >= len(self.table)):
            out[at] = self.other(int(symbols[at]) - len(self.table))
        return out

    def other(self, code: int) -> np.ndarray:
        if code not in self.made:
            if len(self.made) >= REMEMBERED:
                self.made.clear()
            self.made[code] = np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), DIM)
        return self.made[code]


def letter_vectors(count: int) -> LetterVectors:
    return LetterVectors(count)


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, one after the other, and the text of each. Runs of non-letters become one gap."""
    parts = [f" {t.lower()} " for t in texts]
    code = codepoints("".join(parts))
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), np.fromiter(map(len, parts), np.int64, len(parts)))
    small = table[code]
    keep = (small != GAP) | np.append(True, small[1:] != small[:-1])
    return small[keep], owner[keep]


@cache
def all_letters() -> np.ndarray:
    return np.array([c for c in range(POINTS) if chr(c).isalpha()], np.int32)


def symbol_table(alphabet: list[int]) -> np.ndarray:
    """The symbol of every code point: 2 and on for the alphabet, numbers after them for all other letters."""
    table = np.zeros(POINTS, np.int32)
    table[all_letters()] = all_letters() + len(alphabet) + 2
    table[alphabet] = np.arange(2, len(alphabet) + 2)
    return table


def bundles(texts: list[str], table: np.ndarray, vectors: LetterVectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bundled vectors of the texts, and how many letters and how many n-grams each has."""
    made = [_bundles(texts[at : at + TEXTS], table, vectors) for at in range(0, len(texts), TEXTS)]
    return tuple(map(np.concatenate, zip(*made, strict=True))) if made else (np.zeros((0, DIM), np.float32), np.zeros(0), np.zeros(0, np.int64))


def _bundles(texts: list[str], table: np.ndarray, vectors: LetterVectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sym, owner = symbols(texts, table)
    letters = np.bincount(owner, sym != GAP, len(texts))
    out = np.zeros((len(texts), DIM), np.float32)
    if len(sym) < N:
        return out, letters, np.zeros(len(texts), np.int64)
    same = np.flatnonzero(owner[: len(sym) - N + 1] == owner[N - 1 :])
    code = np.zeros(len(same), np.int64)
    for k in range(N):
        code = code << BITS | sym[same + k]
    numbered = pa.array(code).dictionary_encode()  # grams as they come; only those that occur take room
    grams, place, who = numbered.dictionary.to_numpy(), numbered.indices.to_numpy(), owner[same]
    for at in range(0, len(grams), SLICE):
        own = grams[at : at + SLICE]
        bound = np.ones((len(own), DIM), np.int8)
        for k in range(N):
            letter, which = np.unique(own >> BITS * (N - 1 - k) & (1 << BITS) - 1, return_inverse=True)
            bound *= np.roll(vectors[letter], k, axis=1)[which]
        mine = (place >= at) & (place < at + SLICE) if len(grams) > SLICE else slice(None)
        counts = np.bincount(who[mine].astype(np.int64) * len(own) + place[mine] - at, minlength=len(texts) * len(own))
        out += counts.astype(np.float32).reshape(len(texts), len(own)) @ bound.astype(np.float32)
    return out, letters, np.bincount(who, minlength=len(texts))


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=-1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def fit(rows: list[tuple[str, str]]) -> Model:
    """Learn prototypes from (text, language)."""
    seen: dict[str, int] = {}
    for text, _ in rows:
        for c in set(text.lower()):
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
    alphabet = [ord(c) for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: LETTERS - 2]]
    table, vectors = symbol_table(alphabet), letter_vectors(len(alphabet) + 2)
    languages = sorted({lang for _, lang in rows})
    sums = np.zeros((len(languages), DIM), np.float64)
    each = [(np.zeros((0, DIM), np.float32), np.zeros(0))]
    which = np.array([languages.index(lang) for _, lang in rows], np.int64)
    for at in range(0, len(rows), 200):
        made, _, grams = bundles([t for t, _ in rows[at : at + 200]], table, vectors)
        np.add.at(sums, which[at : at + 200], unit(made))
        each.append((unit(made), np.divide(np.linalg.norm(made, axis=1), grams, out=np.zeros(len(made)), where=grams > 0)))
    own = unit(sums)
    centre = own.mean(axis=0) if len(languages) > 1 else np.zeros(DIM)
    vector, length = (np.concatenate(x) for x in zip(*each, strict=True))
    median = np.array([median_projection(sums[k], vector[which == k], length[which == k]) for k in range(len(languages))], np.float32)
    return Model(languages, alphabet, centre.astype(np.float32), unit(own - centre).astype(np.float32), own.astype(np.float32), median)


def median_projection(total: np.ndarray, made: np.ndarray, length: np.ndarray) -> float:
    """The median projection of a language's training texts, each on the sum of all others; 0 where there are no others."""
    # (total - x) . x and |total - x|, of all x of length 1, without a copy of the texts' vectors
    dot, there = made @ total, (length > 0).astype(float)
    rest = np.sqrt(np.maximum(total @ total - 2 * dot + there, 0))
    known = (length > 0) & (rest > 1e-3)
    return max(float(np.median(length[known] * (dot - there)[known] / rest[known])), 0.0) if known.any() else 0.0


class Predictor:
    def __init__(self, model: Model) -> None:
        self.model, self.table, self.vectors = model, symbol_table(model.alphabet), letter_vectors(len(model.alphabet) + 2)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether the text is known to be in it."""
        made, letters, grams = bundles([t or "" for t in texts], self.table, self.vectors)
        if not self.model.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        cosine = unit(unit(made) - self.model.centre) @ self.model.prototypes.T
        best = cosine.argmax(axis=1)
        n = np.maximum(grams, 1)
        projection = (made * self.model.own[best]).sum(axis=1) / n
        known = (letters > 0) & (projection >= self.model.median[best] * (SHARE - SLACK / np.sqrt(n)))
        score = np.where(letters > 0, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.model.languages[b] if k else "und" for b, k in zip(best, letters, strict=True)], score.astype(np.float64), known


def training_rows(docs: DataFrame, rows: int) -> list[tuple[str, str]]:
    """At most ``rows`` texts with a language, outside the held-out fold, by smallest id hash; of rows that share an id, the first by text."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    first = usable.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("first")).select("doc_id", "first.*")
    found = within(first).orderBy("doc_id").collect()
    return [(r["text"], r["lang"]) for r in found]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # a few vectors: fixed size

    def run(batches):
        predictor = Predictor(sent.value)
        for rest, texts in chunks(batches, limit=1_000_000):
            lang, score, known = predictor(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rest["doc_id"], pa.int64()), "held_out": pa.array(rest["held_out"], pa.bool_()), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "known": pa.array(known, pa.bool_())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, known boolean")


def with_language(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learned language.

    Rejected are texts that are not known: those without a letter, and those whose n-grams project too little on the nearest prototype.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, train_rows)))

    def make():
        predictor = Predictor(sent.value)

        def decide(texts):
            return predictor(texts)[2]

        return decide

    return keep_rows(docs, make)


def language(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn prototypes from ``docs`` and predict the language of every whole text."""
    return predict(docs, fit(training_rows(docs, train_rows)))
