"""Operator 2, best-fit packing of documents into token sequences.

A document's tokens end with one separator. Longer documents than a sequence are cut into pieces of a whole sequence
each, but for the first, which holds the rest. Pieces are packed online: a fixed number of bins is open; an integer used
as a bitset has bit f set where an open bin has f places free, so the bin that fits best is the lowest bit at or above the
piece's length. A full bin closes; when all bins are open and none fits, the fullest closes.

Each partition packs alone, so no text is shuffled; sequence numbers hold the partition's number in their upper bits. The pieces
in the bins that partitions leave open are then packed once more, the same way and in an order by hash, about ``AGAIN`` bins' to a
partition; so few bins stay half empty however many partitions there are.

Defined results: null and empty texts are one separator; repeated rows are packed each on its own; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks
from tessera.llm.units import USUAL
from tessera.runtime import materialise, ship_file, ship_package, shipped_file

#: Bins that are open at a time.
OPEN = 1024
#: Open bins whose pieces are packed again in one partition, and numbers of open bins that are sent to all tasks at most (beyond
#: that they are joined).
AGAIN, SMALL = 50_000, 1_000_000
SEPARATOR = (0).to_bytes(4, "little")


class Bins:
    """Bounded-space online best-fit over bins of ``size`` places."""

    def __init__(self, size: int, open_bins: int = OPEN, first: int = 0) -> None:
        self.size, self.limit, self.next = size, open_bins, first
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it that a piece of 1 to ``size`` places gets."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            own = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            own, free = self.next, self.size
            self.next += 1
        if free > length:
            self.by_free.setdefault(free - length, []).append(own)
            self.bits |= 1 << (free - length)
            self.open += 1
        return own, self.size - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        own = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return own


def pieces(tokens: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document: all are whole sequences but perhaps the first."""
    start, length = 0, tokens % size or min(size, tokens)
    while start < tokens:
        yield start, length
        start, length = start + length, size


def byte_spelling() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable ones (Latin-1) stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Texts to the ids (little-endian unsigned 32-bit) that the tokenizers library gives for a vocabulary file.

    A byte-level vocabulary whose merges have ascending ids, without normaliser and with the usual pattern, is a table of ranks;
    such a table is merged by the faster tiktoken library, which gives the same ids. Any other file is left to tokenizers.
    A special token's name in a text is ordinary text.
    """

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.fast = self.slow = None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ranks = rank_table(file) if pattern == USUAL else None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            self.slow.encode_special_tokens = True

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.fast is not None:
            return [self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes() for t in texts]
        return [np.array(x.ids, "<u4").tobytes() for x in self.slow.encode_batch_fast(texts, add_special_tokens=False)]


def rank_table(file: dict) -> dict[bytes, int] | None:
    """The bytes and rank of every token of a byte-level vocabulary, or None where ranks alone do not say how to merge."""
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    if model.get("type") != "BPE" or file.get("normalizer") or not usual or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary.get("".join(m), -1) for m in merges]
    if -1 in ids or any(a >= b for a, b in zip(ids, ids[1:])):
        return None
    spelled, merged = byte_spelling(), {"".join(m) for m in merges}
    ranks = {bytes(spelled[c] for c in token): i for token, i in vocabulary.items() if token in merged or token in spelled}
    # single bytes come before all merges, and there is nothing else
    return ranks if len(ranks) == len(merged) + 256 and max(vocabulary[c] for c in spelled) < ids[0] else None


_TOKENIZERS: dict[tuple[str, str], Encoder] = {}


def tokenizer(name: str, pattern: str) -> Encoder:
    """The worker's tokenizer, from a shipped file."""
    if (name, pattern) not in _TOKENIZERS:
        _TOKENIZERS[name, pattern] = Encoder(shipped_file(name), pattern)
    return _TOKENIZERS[name, pattern]


def pack(docs: DataFrame, path: str, pattern: str, size: int = 2048, open_bins: int = OPEN, small: int = SMALL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each document."""
    ship_package(docs.sparkSession)
    name = ship_file(docs.sparkSession, path)
    columns = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}

    def run(batches):
        cut = tokenizer(name, pattern)
        bins = Bins(size, open_bins, TaskContext.get().partitionId() << 40)
        for rest, texts in chunks(batches):
            out: dict[str, list] = {k: [] for k in columns}
            for doc, ids in zip(rest["doc_id"], cut([t or "" for t in texts]), strict=True):
                ids += SEPARATOR
                for k, (start, length) in enumerate(pieces(len(ids) // 4, size)):
                    own, offset = bins.place(length)
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), own, offset), strict=True):
                        out[column].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, columns[k]) for k, v in out.items()})
        # the bins left open are rows of piece -1
        left = sorted(own for owns in bins.by_free.values() for own in owns)
        none = pa.nulls(len(left), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array([-1] * len(left), pa.int32()), none, none, none, pa.array(left, pa.int64()), none], list(columns))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    made = materialise(made, "pieces")
    left, placed = made.where("piece < 0").select("sequence_id"), made.where("piece >= 0")
    count = left.count()
    left = F.broadcast(left) if count <= small else left

    def again(batches):
        bins = Bins(size, open_bins, 1 << 62 | TaskContext.get().partitionId() << 40)
        for batch in batches:
            into = [bins.place(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([x[j] for x in into], pa.int64()) for j in (0, 1))], list(columns))

    loose = placed.join(left, "sequence_id", "left_semi").select(*columns).repartition(max(1, -(-count // AGAIN)), "sequence_id")
    loose = loose.sortWithinPartitions(F.xxhash64("doc_id", "piece"), "sequence_id", "offset")
    return placed.join(left, "sequence_id", "left_anti").select(*columns).unionByName(loose.mapInArrow(again, schema))
