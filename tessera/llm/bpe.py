"""Operator 6, byte-level BPE by ranks: encoding and decoding.

A text is cut by the tokenizer's pattern. Pieces that are tokens themselves are done; the others are put into padded
matrices, one for each bucket of lengths, a row for a piece and a column for a token. In each round every row merges
its leftmost pair of least rank: ranks of pairs come from an open-addressing hash table in numpy, the columns behind
the merge move one place left, and rows without a pair that may merge leave the matrix (compaction). Pieces longer than
``LONG`` bytes, whose rounds would grow with the square of the length, are merged with a heap instead; the order of
merges is the same.

Decoding joins the bytes of the ids.

Defined results: null and empty texts have no ids; equal texts get equal ids; any text (control characters, NUL, unknown
scripts, lone long words) round-trips; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, mix
from tessera.llm.units import PieceCodec
from tessera.runtime import ship_file, ship_package, shipped_file

#: Upper ends of the length buckets of the matrices, and rows of a matrix at most.
BUCKETS, ROWS = (4, 8, 12, 16, 24, 32, 64, 128, 256), 50_000
LONG = BUCKETS[-1]
NONE = np.int32(2**31 - 1)


class Ranks:
    """A rank table: bytes of each token, and a hash table from pairs of ids to the merged id (its rank)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.of = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.mask = np.uint64((1 << max(4, int(4 * max(1, len(pairs))).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, np.uint64(2**64 - 1))
        self.values = np.full(int(self.mask) + 1, NONE)
        self.probes = 0
        slot = mix(keys) & self.mask
        left = np.arange(len(keys))
        while len(left):  # place all keys at once; those whose slot is taken try the next slot
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            at = left[free]
            self.keys[slot[at]] = keys[at]
            won = at[self.keys[slot[at]] == keys[at]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            self.probes += 1

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it doesn't merge (ids below 0 never do)."""
        key = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(key.shape, NONE)
        slot = mix(key) & self.mask
        hit = self.keys[slot] == key
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of 1 to LONG bytes, as bytes of 32-bit numbers."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        flat = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((len(pieces), width), np.int32(-1))
        ids[np.arange(width)[None, :] < sizes[:, None]] = flat
        rank = np.full((len(pieces), width), NONE)
        if width > 1:
            rank[:, :-1] = np.where(ids[:, 1:] >= 0, self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1), NONE)
        done: list[bytes] = [b""] * len(pieces)
        who = np.arange(len(pieces))
        columns = np.arange(width)
        while len(who):
            at = rank.argmin(axis=1)  # the leftmost of least rank
            best = rank[np.arange(len(who)), at]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[who[k]] = ids[k, : sizes[who[k]]].tobytes()
                keep = ~over
                ids, rank, who, at, best = ids[keep], rank[keep], who[keep], at[keep], best[keep]
                if not len(who):
                    break
                width = int(sizes[who].max())
                ids, rank, columns = ids[:, :width], rank[:, :width], columns[:width]
            rows = np.arange(len(who))
            ids[rows, at] = best
            move = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, move, 1), np.take_along_axis(rank, move, 1)
            sizes[who] -= 1
            ids[rows, sizes[who]] = -1
            rank[rows, np.maximum(sizes[who] - 1, 0)] = NONE
            rank[rows, sizes[who]] = NONE
            for shift in (0, -1):  # the pairs of the merged token with its neighbours
                ok = (at + shift >= 0) & (at + shift + 1 < sizes[who])
                r, c = rows[ok], at[ok] + shift
                rank[r, c] = self.pair(ids[r, c], ids[r, c + 1])
        return done

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, by a heap over a linked list."""
        ids = [int(self.byte[b]) for b in piece]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.pair(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0:
                    key = (ids[x], ids[y])
                    if key not in known:
                        known[key] = int(self.pair(np.array([key[0]]), np.array([key[1]]))[0])
                    if known[key] != NONE:
                        heapq.heappush(heap, (known[key], x, *key))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. The pieces may come in any order; a piece that is a token is that token."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(raw):
            known = self.of.get(p)
            if known is not None:
                out[k] = known.to_bytes(4, "little")
            elif len(p) > LONG:
                out[k] = self.merge_long(p)
            elif p:
                groups.setdefault(next(b for b in BUCKETS if len(p) <= b), []).append(k)
        for own in groups.values():
            for at in range(0, len(own), ROWS):
                part = own[at : at + ROWS]
                for k, ids in zip(part, self.merge_matrix([raw[k] for k in part]), strict=True):
                    out[k] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        look = self.bytes.__getitem__
        return b"".join(map(look, np.frombuffer(ids, np.uint32).tolist()))


_CODECS: dict[tuple[str, str], tuple[Ranks, PieceCodec]] = {}


def codec(path: str, pattern: str) -> tuple[Ranks, PieceCodec]:
    """The worker's rank table and caches for a vocabulary file."""
    if (path, pattern) not in _CODECS:
        ranks = Ranks.load(path)
        _CODECS[path, pattern] = ranks, PieceCodec(pattern, lambda pieces, words: ranks.encode_pieces([*pieces, *[" " + w for w in words]]))
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text, ids (binary, little-endian unsigned 32-bit numbers) of every row."""
    ship_package(docs.sparkSession)
    name = ship_file(docs.sparkSession, path)

    def run(batches):
        _, cut = codec(shipped_file(name), pattern)
        for rest, texts in chunks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rest["doc_id"], pa.int64()), "text": pa.array(texts, pa.string()), "ids": pa.array(cut([t or "" for t in texts]), pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of a table with doc_id and ids."""
    ship_package(encoded.sparkSession)
    name = ship_file(encoded.sparkSession, path)

    def run(batches):
        ranks, _ = codec(shipped_file(name), pattern)
        for rest, ids in chunks(batches, "ids"):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rest["doc_id"], pa.int64()), "decoded": pa.array([ranks.decode(x or b"") for x in ids], pa.binary())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes its ids in one pass."""
    ship_package(docs.sparkSession)
    name = ship_file(docs.sparkSession, path)

    def run(batches):
        ranks, cut = codec(shipped_file(name), pattern)
        for rest, texts in chunks(batches):
            ids = cut([t or "" for t in texts])
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(rest["doc_id"], pa.int64()),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(ranks.decode(x)).hexdigest() for x in ids], pa.string()),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
