"""Operator 4, language-model scores by stupid backoff, computed relationally.

Four tables, joined by keys:

1. ``blocks`` (block, words, docs): the documents, put into blocks of bounded size; bucketed by block, so that step 4 joins
   without shuffling a text.
2. ``exploded`` (cell, block, n, codes, counts): the n-grams of order 1 to ``ORDER`` of all documents. A cell is a range of
   hashes; how many there are follows the corpus, so a cell holds about ``CELL`` n-grams at any size. A row holds the distinct
   n-grams of one block in one cell as a sorted column of codes and a column of counts: a frequent n-gram is one entry a block,
   however often it occurs, and no cell is hot. There is a row only where a block has such n-grams, so rows never outnumber
   distinct n-grams of blocks, which grow in proportion to the input.
3. ``joined``: partitioned by cell. A cell's count table is the sum over its rows; joined back by code, every row learns what
   its n-grams count in all other blocks. A task holds one cell at a time, whatever its partition holds.
4. What comes back for a block is gathered and joined with its documents by block; scores are summed per document:
   S(w | u v) is the ratio of counts of u v w and u v where u v w was seen, else ``ALPHA`` times S(w | v), down to the word's
   share of all words; a word never seen counts half.

A document's own occurrences are taken off all counts (leave one out), so its score says how much the *rest* of the corpus
expects it. Counts are over all documents and grow with the input.

Defined results: words are runs of non-white space, lower-cased; null and texts without words have 0 words, sum 0 and a null
mean; repeated rows are documents of their own, so each is expected by the other; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHE_WORDS, chunks, mix, release_memory
from tessera.runtime import scratch_path, ship_package

#: Longest n-gram, backoff factor, characters of text in a block, n-grams (before equal ones of a block are put together) in a cell.
ORDER, ALPHA, BLOCK_CHARS, CELL = 3, 0.4, 6_000_000, 6_000_000
#: Bits that tell the n-grams of one cell apart. As a cell holds a few million n-grams at any size of the corpus, about one
#: n-gram in a billion shares its code with another one.
BITS = 52


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=4)
        return h


def words_of(texts: list[str], memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of the text of each."""
    if len(memory) > CACHE_WORDS:
        memory.clear()
    look = memory.__getitem__
    own = [np.fromiter(map(look, parts), np.uint64, len(parts)) for parts in (t.lower().split() for t in texts)]
    return (np.concatenate(own) if own else np.zeros(0, np.uint64)), np.repeat(np.arange(len(texts)), np.fromiter(map(len, own), np.int64, len(own)))


def grams(words: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each word, and whether there is one (a row an order)."""
    hashes, there = np.zeros((order, len(words)), np.uint64), np.zeros((order, len(words)), bool)
    h = np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        # the hash of the n - 1 words up to the one before, with this word
        h = mix(words + np.uint64(1)) if n == 1 else mix(np.append(np.zeros(1, np.uint64), h[:-1]) * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(n << 20))
        there[n - 1, n - 1 :] = doc[n - 1 :] == doc[: len(doc) - n + 1] if n > 1 else True
        hashes[n - 1] = h
    return hashes, there


def codes(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Cell (by the upper half of a hash, or all of it where there are more cells) and BITS further bits, as one sortable number.

    The number has 64 bits: with 2^12 cells or more, the cell's bits are the hash's own upper bits and all of the hash counts.
    """
    if cells >= 1 << 64 - BITS:
        return hashes
    cell = (hashes >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)
    return cell << np.uint64(BITS) | hashes & np.uint64((1 << BITS) - 1)


def cell_ends(sorted_codes: np.ndarray, cells: int) -> Iterator[tuple[int, int, int]]:
    """(cell, start, end) of each cell that has codes; codes are sorted."""
    cell = sorted_codes >> np.uint64(BITS) if cells < 1 << 64 - BITS else (sorted_codes >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    yield from zip(cell[start].astype(np.int64).tolist(), start.tolist(), np.append(start[1:], len(cell)).tolist(), strict=True)


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, how often each occurs, and the place of every element among them; by one sort."""
    order = np.argsort(a)
    s = a[order]
    edge = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
    start = np.flatnonzero(edge)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(edge) - 1
    return s[start], np.diff(np.append(start, len(s))), place


def packed(a: np.ndarray) -> bytes:
    """Numbers with all first bytes before all second bytes, and so on, compressed: the upper ones are mostly 0."""
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """block, words, docs (compressed): a table in the shared folder, bucketed by block."""
    spark = docs.sparkSession

    def run(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[str] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal number, held
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], ["doc_id", "text"])
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_batch(batch)
            words = sum([len(t.split()) for t in texts])
            made = pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "words": pa.array([words], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
            number += 1
            held = 0
            ids.clear(), texts.clear()
            return made

        for rest, own in chunks(batches, limit=BLOCK_CHARS):
            for d, t in zip(rest["doc_id"], own, strict=True):
                ids.append(d), texts.append(t or "")
                held += len(t or "")
                if held >= BLOCK_CHARS:
                    yield close()
        if ids:
            yield close()

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "block long, words long, docs binary")
    name = f"tessera_lm_blocks_{uuid.uuid4().hex}"
    made.write.bucketBy(buckets(spark), "block").format("parquet").option("compression", "uncompressed").option("path", scratch_path(spark, "lm-blocks")).saveAsTable(name)
    return spark.table(name)


def buckets(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(docs: bytes) -> tuple[list[str], pa.Array]:
    batch = pa.ipc.open_stream(docs).read_all()
    return batch["text"].to_pylist(), batch["doc_id"].combine_chunks().cast(pa.int64())


def exploded(made: DataFrame, cells: int, order: int) -> DataFrame:
    """cell, block, n, codes, counts: the distinct n-grams of each block in each cell."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            for at in range(batch.num_rows):
                words, doc = words_of(texts_of(batch.column(1)[at].as_py())[0], memory)
                hashes, there = grams(words, doc, order)
                own = hashes[there]
                del hashes, there, words, doc
                found, counts, _ = distinct(codes(own, cells))
                del own
                rows = [(cell, end - start, packed(np.diff(found[start:end], prepend=np.uint64(0))), packed(counts[start:end].astype(np.uint32))) for cell, start, end in cell_ends(found, cells)]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                cell, n, code, count = (pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))
                yield pa.RecordBatch.from_arrays([cell, pa.array([batch.column(0)[at].as_py()] * len(rows), pa.int64()), n, code, count], ["cell", "block", "n", "codes", "counts"])
                release_memory()

    return made.select("block", "docs").mapInArrow(run, "cell long, block long, n long, codes binary, counts binary")


def joined(grams: DataFrame, parts: int) -> DataFrame:
    """block, cell, n, elsewhere: for each row of n-grams, how often each of them occurs in all other blocks."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        cell: int | None = None
        of: list[int] = []
        code: list[np.ndarray] = []
        count: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            if not of:
                return
            ends = np.cumsum(list(map(len, code)))
            every, own = np.concatenate(code), np.concatenate(count).astype(np.int64)
            code.clear(), count.clear()
            order = np.argsort(every, kind="stable")
            s = every[order]
            del every
            start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            del s
            # the cell's count table is `total`, one number for each distinct code; joined back, less the block's own
            total = np.add.reduceat(own[order], start)
            elsewhere = np.empty_like(own)
            elsewhere[order] = np.repeat(total, np.diff(np.append(start, len(order))))
            elsewhere -= own
            begin = 0
            for b, end in zip(of, ends.tolist(), strict=True):
                # what a block's n-grams count elsewhere is mostly 0, and so compresses better than the totals
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([cell], pa.int64()), pa.array([end - begin], pa.int64()), pa.array([packed(elsewhere[begin:end].astype(np.uint64))], pa.binary())], ["block", "cell", "n", "elsewhere"])
                begin = end
            of.clear()
            release_memory()

        for batch in batches:
            for c, b, n, h, k in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
                if c != cell:
                    yield from close()
                    cell = c
                of.append(b)
                code.append(np.cumsum(unpacked(h, np.uint64, n), dtype=np.uint64))
                count.append(unpacked(k, np.uint32, n))
        yield from close()

    return grams.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "block long, cell long, n long, elsewhere binary")


def score_block(texts: list[str], elsewhere: np.ndarray, corpus: int, order: int, cells: int, memory: WordHashes, alpha: float = ALPHA) -> dict[str, np.ndarray]:
    """Scores of a block's documents; ``elsewhere``: occurrences of each of its distinct n-grams, by ascending code, in all other blocks."""
    words, doc = words_of(texts, memory)
    hashes, there = grams(words, doc, order)
    _, inside, every = distinct(codes(hashes[there], cells))
    total = elsewhere.astype(np.int64) + inside
    n_words = np.bincount(doc, minlength=len(texts))
    rest = np.maximum(corpus - n_words, 1).astype(np.float64)[doc]
    count = np.zeros(hashes.shape, np.int64)  # occurrences outside the document
    start = 0
    for n in range(order):
        at = np.flatnonzero(there[n])
        place = every[start : start + len(at)]
        start += len(at)
        _, times, which = distinct(doc[at].astype(np.int64) * len(total) + place)
        count[n, at] = total[place] - times[which]
    value = np.where(count[0] > 0, count[0], 0.5) / rest
    level = np.where(count[0] > 0, 1, 0)
    for n in range(1, order):
        before = np.append(np.zeros(1, np.int64), count[n - 1, :-1])  # the count of the context
        seen = there[n] & (count[n] > 0) & (before > 0)
        value = np.where(seen, np.minimum(count[n] / np.maximum(before, 1), 1.0), np.where(there[n], alpha * value, value))
        level = np.where(seen, n + 1, level)
    logs = np.bincount(doc, np.log(value), len(texts))
    return {"n_words": n_words, "score_sum": logs, "backed_off": np.bincount(doc, (level < order).astype(float), len(texts)).astype(np.int64), "unseen": np.bincount(doc, (level == 0).astype(float), len(texts)).astype(np.int64)}


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, score_sum (natural log), score_mean, backed_off, unseen of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    made = blocks(docs)
    corpus = int(made.agg(F.sum("words")).first()[0] or 0)
    cells = max(1, -(-corpus * order // CELL))
    back = joined(exploded(made, cells, order), buckets(spark))
    # of one block: bounded by the block's own n-grams
    gathered = back.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("cell", "n", "elsewhere"))).alias("cells"))
    both = made.hint("merge").join(gathered, "block", "left").select("docs", F.col("cells.n").alias("n"), F.col("cells.elsewhere").alias("elsewhere"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            for at in range(batch.num_rows):
                docs_, n, got = (batch.column(j)[at].as_py() for j in range(3))
                texts, ids = texts_of(docs_)
                elsewhere = np.concatenate([unpacked(raw, np.uint64, k) for k, raw in zip(n, got, strict=True)]) if got else np.zeros(0, np.uint64)
                del docs_, got
                out = score_block(texts, elsewhere, corpus, order, cells, memory)
                mean = np.divide(out["score_sum"], out["n_words"], out=np.full(len(out["n_words"]), np.nan), where=out["n_words"] > 0)
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_words": pa.array(out["n_words"], pa.int64()), "score_sum": pa.array(out["score_sum"], pa.float64()), "score_mean": pa.array(mean, pa.float64(), mask=out["n_words"] == 0), "backed_off": pa.array(out["backed_off"], pa.int64()), "unseen": pa.array(out["unseen"], pa.int64())})
                release_memory()

    return both.mapInArrow(run, "doc_id long, n_words long, score_sum double, score_mean double, backed_off long, unseen long")
