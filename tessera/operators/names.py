"""Duplicates by collection name: exact and fuzzy (Jaro-Winkler), counted by scope.

A member is an EVM contract with its commonest usable name (ties: the smallest), or a Solana NFT with its own name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tessera.functions.similarity import BOOST, PREFIX, SCALE, jaro_winkler, jaro_winkler_udf
from tessera.functions.text import usable_name

#: 64-bit words of a name's bitmap of letters (192 bits at most are counted in a byte, and 255 stands for none), and parts into which names are dealt; each pair of parts is one block of pairs.
WORDS, PARTS = 3, 12


def members(nft: DataFrame) -> DataFrame:
    """chain, contract, name, members, nfts. Solana's NFTs are grouped by contract and name."""
    named = nft.where(usable_name(F.col("name_norm")))
    size = nft.groupBy("chain", "contract").agg(F.count(F.lit(1)).alias("nfts"))
    counts = named.groupBy("chain", "contract", F.col("name_norm").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    evm = counts.where("chain != 'solana'").groupBy("chain", "contract").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("name"))).alias("best")).select("chain", "contract", F.col("best.name").alias("name"))
    evm = evm.join(size, ["chain", "contract"]).select("chain", "contract", "name", F.lit(1).cast("long").alias("members"), "nfts")
    solana = counts.where("chain = 'solana'").select("chain", "contract", "name", F.col("n").alias("members"), F.col("n").alias("nfts"))
    return evm.unionByName(solana)


def exact_hits(own: DataFrame) -> DataFrame:
    """chain, contract, name, nfts, peer: every chain in which another member has the same name."""
    seen = own.groupBy("name", F.col("chain").alias("peer")).agg(F.sum("members").alias("n"))
    return own.join(seen, "name").where((F.col("peer") != F.col("chain")) | (F.col("n") >= 2)).select("chain", "contract", "name", "nfts", "peer")


def similar_names(names: DataFrame, threshold: float, probes: DataFrame | None = None) -> DataFrame:
    """left, right (left < right), score: pairs of distinct names of at least this similarity.

    With ``probes`` (name), the plan starts from them: left is a probe and right any other name.

    A threshold of 0 or less asks for all pairs, by definition. Above, names are dealt into ``PARTS`` parts by hash, and every pair
    of parts is compared in one task: bitmaps of letters bound the letters that two names share, and with their common prefix the
    similarity, so no pair is lost; what passes is compared exactly. Only a few bytes a name are dealt out, ``PARTS`` times at most.
    The work grows with the square of the names, at some nanoseconds a pair.
    """
    if threshold <= 0:
        every = names.select("name").distinct()
        first = every if probes is None else probes.select("name").distinct()
        both = first.select(F.col("name").alias("left")).crossJoin(every.select(F.col("name").alias("right"))).where("left < right" if probes is None else "left != right")
        return both.withColumn("score", jaro_winkler_udf("left", "right"))
    own = names.select("name").distinct().where("name != ''")
    part = F.pmod(F.xxhash64("name"), F.lit(PARTS)).cast("int")
    parts = F.sequence(F.lit(0), F.lit(PARTS - 1))
    if probes is None:  # a block is a pair of parts, the smaller one first
        blocks = F.transform(parts, lambda i: F.struct((F.least(i, part) * PARTS + F.greatest(i, part)).alias("block"), (part <= i).alias("first"), (part >= i).alias("second")))
        dealt = own.withColumn("at", F.explode(blocks)).select("name", "at.*")
    else:
        first, second = probes.select("name").distinct().where("name != ''"), own
        deal = [first.withColumn("i", F.explode(parts)).select("name", (part * PARTS + F.col("i")).alias("block"), F.lit(True).alias("first"), F.lit(False).alias("second"))]
        deal.append(second.withColumn("i", F.explode(parts)).select("name", (F.col("i") * PARTS + part).alias("block"), F.lit(False).alias("first"), F.lit(True).alias("second")))
        dealt = deal[0].unionByName(deal[1])
    schema = t.StructType([t.StructField("left", t.StringType()), t.StructField("right", t.StringType()), t.StructField("score", t.DoubleType())])
    both = probes is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            keys = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if s < e:
                    if keys[s] != block and held:
                        yield from _compared(pa.Table.from_batches(held), threshold, both)
                        held = []
                    block = keys[s]
                    held.append(batch.slice(s, e - s))
        if held:
            yield from _compared(pa.Table.from_batches(held), threshold, both)

    return dealt.repartition(PARTS * PARTS, "block").sortWithinPartitions("block").mapInArrow(run, schema)


class _Letters:
    """Names as arrays: bitmaps of their letters (each with its running number), lengths and first letters."""

    def __init__(self, names: list[str]):
        bits, prefix, place = np.zeros((len(names), WORDS * 64), bool), np.zeros((len(names), PREFIX), np.uint32), {}
        for i, name in enumerate(names):
            seen: dict[str, int] = {}
            for c in name:
                seen[c] = seen.get(c, 0) + 1
                if (c, seen[c]) not in place:
                    place[c, seen[c]] = zlib.crc32(f"{c}{seen[c]}".encode("utf-8", "surrogatepass")) % (WORDS * 64)
                bits[i, place[c, seen[c]]] = True
            prefix[i, : len(name[:PREFIX])] = [ord(c) + 1 for c in name[:PREFIX]]
        size = np.array([len(name) for name in names], np.int64)
        self.order = np.lexsort((bits.sum(1), size))  # names of one length and one number of bits are a run
        self.names, self.size, self.prefix = [names[i] for i in self.order], size[self.order], prefix[self.order]
        self.words = np.ascontiguousarray(np.packbits(bits[self.order], axis=1).view(np.uint64).T)
        self.held = bits.sum(1)[self.order]
        kinds = np.stack([self.size, self.held], 1)
        self.runs = [0, *(np.flatnonzero((np.diff(kinds, axis=0) != 0).any(1)) + 1), len(names)] if names else [0]


def _best(n: np.ndarray, m: np.ndarray, shared: np.ndarray, prefix: np.ndarray | int) -> np.ndarray:
    """The most that the similarity can be with so many shared letters and such a common prefix."""
    jaro = (shared / n + shared / m + 1) / 3
    return np.where(shared > 0, np.where(jaro > BOOST, jaro + SCALE * prefix * (1 - jaro), jaro), 0.0)


def _compared(table: pa.Table, threshold: float, both: bool) -> Iterator[pa.RecordBatch]:
    """The similar pairs of a block; ``both``: pairs in one order only, where a name may be on either side."""
    names, first, second = (table.column(c).to_pylist() for c in ("name", "first", "second"))
    one, two = _Letters([x for x, y in zip(names, first, strict=True) if y]), _Letters([x for x, y in zip(names, second, strict=True) if y])
    same = both and all(first) and all(second)
    found: list[tuple[str, str, float]] = []

    def made() -> pa.RecordBatch:
        pairs = [(min(a, b), max(a, b), x) if both else (a, b, x) for a, b, x in found]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pairs, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], names=["left", "right", "score"])

    def most(n: int, held: int, m: np.ndarray, other: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Letters that two names share are at most a name's letters less its bits that the other lacks."""
        return np.minimum(np.minimum(n - held + bits, m - other + bits), np.minimum(n, m))

    for s, e in zip(one.runs, one.runs[1:], strict=False):
        n, held = one.size[s], one.held[s]
        least = np.full(len(two.names), 255, np.uint8)  # bits that each name must share with those of the run
        for u, v in zip(two.runs, two.runs[1:], strict=False):
            bits = np.arange(min(held, two.held[u]) + 1)
            enough = np.flatnonzero(_best(n, two.size[u], most(n, held, two.size[u], two.held[u], bits), PREFIX) >= threshold - 1e-9)
            if len(enough):
                least[u:v] = enough[0]
        for i in range(s, e):
            for low in range(i + 1 if same else 0, len(two.names), 32768):
                part = slice(low, low + 32768)
                bits = np.bitwise_count(two.words[0, part] & one.words[0, i])
                for w in range(1, WORDS):
                    bits += np.bitwise_count(two.words[w, part] & one.words[w, i])
                near = np.flatnonzero(bits >= least[part])
                if len(near):
                    j = near + low
                    prefix = np.cumprod((two.prefix[j] == one.prefix[i]) & (one.prefix[i] > 0), axis=1).sum(1)
                    shared = most(n, held, two.size[j], two.held[j], bits[near].astype(np.int64))
                    a = one.names[i]
                    for k in j[_best(n, two.size[j], shared, prefix) >= threshold - 1e-9]:
                        b = two.names[k]
                        if a != b and (x := jaro_winkler(a, b)) >= threshold - 1e-12:
                            found.append((a, b, x))
                if len(found) >= 2000:
                    yield made()
    if found:
        yield made()


def fuzzy_hits(own: DataFrame, threshold: float) -> DataFrame:
    """Exact hits and those of similar names; similarity is not carried on to a third name."""
    pairs = similar_names(own, threshold)
    both = pairs.select(F.col("left").alias("name"), F.col("right").alias("other")).unionByName(pairs.select(F.col("right").alias("name"), F.col("left").alias("other")))
    at = own.select(F.col("name").alias("other"), F.col("chain").alias("peer")).distinct()
    near = own.join(both, "name").join(at, "other").select("chain", "contract", "name", "nfts", "peer")
    return exact_hits(own).unionByName(near).distinct()


def name_scopes(hits: DataFrame) -> DataFrame:
    """scope, chain, peer, contracts, nfts."""
    scope = F.when(F.col("peer") == F.col("chain"), F.array(F.struct(F.lit("intra").alias("scope"), F.col("chain").alias("peer")))).otherwise(F.array(F.struct(F.lit("matrix").alias("scope"), F.col("peer").alias("peer")), F.struct(F.lit("cross").alias("scope"), F.lit("").alias("peer"))))
    rows = hits.select("chain", "contract", "name", "nfts", F.explode(scope).alias("s")).select("chain", "contract", "name", "nfts", "s.scope", "s.peer").distinct()
    return rows.groupBy("scope", "chain", "peer").agg(F.countDistinct("contract").alias("contracts"), F.sum("nfts").alias("nfts"))


def canopy(names: DataFrame, small: int = 64) -> DataFrame:
    """name, block: blocking keys. A prefix of 3 letters; where ``small`` or more names share it, 5 letters and a length bucket."""
    size = names.groupBy(F.substring("name", 1, 3).alias("p3")).agg(F.count(F.lit(1)).alias("n"))
    own = names.withColumn("p3", F.substring("name", 1, 3)).join(size, "p3")
    bucket = F.floor(F.length("name") / 6).cast("string")
    return own.select("name", F.when(F.col("n") < small, F.col("p3")).otherwise(F.concat(F.substring("name", 1, 5), F.lit("|len"), bucket)).alias("block"))


assert math.isclose(SCALE * PREFIX, 0.4)
