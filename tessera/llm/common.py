"""Helpers that the text operators share: bounded chunks of Arrow rows, label splits, bounded training samples."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text that a chunk handed to an operator holds at most (one longer text makes a chunk of its own).
CHUNK_CHARS = 4_000_000
#: Entries that a worker's word cache may hold before it is emptied; bounds a Python worker's memory.
CACHE_WORDS = 300_000
#: Characters that a training sample holds at most.
TRAIN_CHARS = 60_000_000
#: Chunks after which a worker gives freed memory back (as it does at the end of a task).
RELEASE = 16


def cuts(column: pa.Array, limit: int) -> list[int]:
    """Where to cut a column of texts or bytes so that the parts hold ``limit`` bytes at most (or one row)."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, total = [], 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            ends.append(i)
            total = 0
        total += int(n)
    return ends


def release_memory() -> None:
    """Gives memory that was freed back to the system, where the C library can; workers live long and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[dict[str, list], list[str | None]]]:
    """Cut Arrow batches into chunks of bounded text size: (other columns as lists, texts)."""
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        start = 0
        for end in [*cuts(batch.column(at), limit), batch.num_rows]:
            part = batch.slice(start, end - start)
            start = end
            yield {f.name: part.column(k).to_pylist() for k, f in enumerate(part.schema) if k != at}, part.column(at).to_pylist()
            done += 1
            if done % RELEASE == 0:
                release_memory()
    release_memory()


def held_out(doc_id: Column) -> Column:
    """The held-out fold: crc32 of the id's text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def within(found: DataFrame, chars: int = TRAIN_CHARS) -> DataFrame:
    """The rows (doc_id, text, ...) of as many ids, by smallest hash, as hold ``chars`` characters together; an id that does not fit any more is passed over."""
    sizes = found.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).select("doc_id", "n", F.xxhash64("doc_id").alias("h")).collect()
    if sum(r["n"] or 0 for r in sizes) <= chars:
        return found
    kept, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if total + (r["n"] or 0) <= chars:
            total += r["n"] or 0
            kept.append(r["doc_id"])
    return found.where(F.col("doc_id").isin(kept))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list:
    """At most ``rows`` labelled documents outside the held-out fold, of ``TRAIN_CHARS`` characters at most, as (text, label).

    The sample is the ``rows`` labelled ids of smallest hash, so it does not depend on partitioning or file order.
    Ids are chosen from the narrow label table; only then are texts read, so no task holds more than its share. An id with
    conflicting labels has the smallest one.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # at most `rows` narrow rows, a documented parameter: a bounded broadcast
    found = within(texts.join(F.broadcast(picked), "doc_id")).orderBy("doc_id", "text").collect()
    return [(r["text"], int(r["label"])) for r in found]


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], np.ndarray]], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is kept.

    ``make`` is called once a task and gives a function from texts to a boolean array. An empty table stays empty.
    """

    def run(batches):
        decide = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            start = 0
            for end in [*cuts(column, CHUNK_CHARS), batch.num_rows]:
                if end > start:
                    part = batch.slice(start, end - start)
                    yield part.filter(pa.array(decide(column.slice(start, end - start).to_pylist())))
                start = end
        del decide
        release_memory()

    return docs.mapInArrow(run, docs.schema)


class Words(dict):
    """Maps a token to a dense number, growing as tokens come; ``fresh`` holds the ones not yet looked at."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix style): spreads every input bit over the word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
