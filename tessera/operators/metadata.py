"""Duplicates by metadata: BM25 cosine where the two documents are the corpus, with candidates that lose no match.

Weights: a term in one document of the pair has idf ln 2, in both ln 1.2; lengths are relative to the pair's mean length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tessera.functions.similarity import IDF_ONCE, IDF_SHARED, K1, B, weight
from tessera.functions.text import token_key
from tessera.runtime import discard, materialise

#: Least and most that the length factor can be, and steps between them.
LEAST_NORM, MOST_NORM = K1 * (1 - B), K1 * (1 + B)
NORMS = [LEAST_NORM + (MOST_NORM - LEAST_NORM) * j / 8 for j in range(9)]
#: Bits of a document's bitmap of terms, 64-bit words of its folded form, ranges of sizes, and the least share for which bitmaps rule out enough.
BITS, FOLDED, RANGES, SKETCHED = 2048, 4, 48, 0.8
#: Documents and entries of a block that probes visit, files of visiting blocks of a task, and entries of postings that are looked at together.
PART, ENTRIES, TOGETHER, VISITED = 3000, 1 << 20, 8, 250_000
#: Bits of the map by which documents are told from those of no pair, and pairs that are scored together.
MAP, CELL = 1 << 24, 20000


def terms(docs: DataFrame, pattern: str = r"[\p{L}\p{N}]+") -> DataFrame:
    """doc, term, tf of every document (doc, text)."""
    return docs.select("doc", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def least_share(threshold: float) -> float:
    """The least part of a document's squared weights (at the weight of unshared terms) that a match must share.

    With x and y the shared parts of the two sides and r the squared ratio of the two idfs, the cosine is at most
    r sqrt(x y / ((1 - (1 - r) x) (1 - (1 - r) y))) by Cauchy's inequality, which grows with x; so x = 1 bounds y.
    """
    r = (IDF_SHARED / IDF_ONCE) ** 2
    return threshold**2 / (r + (1 - r) * threshold**2)


def prefixes(found: DataFrame, threshold: float, of: DataFrame | None = None) -> DataFrame:
    """doc, term, df: the rarest terms of each document (only of the documents ``of``), one of which every match must hold.

    A match that held none of the first i terms would leave their part of the weights unshared, which may be 1 - ``least_share`` at
    most. Weights fall with the length factor, which depends on the partner: between two neighbouring factors of ``NORMS`` the
    first terms weigh at least what they do at the larger one, and the others at most what they do at the smaller one.
    """
    own = found if of is None else found.join(of, "doc", "left_semi")
    counted = found if of is None else found.join(own.select("term").distinct(), "term", "left_semi")
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("doc").orderBy("df", "term")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    squared = {j: (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)) ** 2 for j, norm in enumerate(NORMS)}
    sums = [F.coalesce(F.sum(w).over(before), F.lit(0.0)).alias(f"p{j}") for j, w in squared.items()] + [F.sum(w).over(after).alias(f"s{j}") for j, w in squared.items()]
    ranked = own.join(df, "term").select("doc", "term", "df", *sums)
    free = 1 - least_share(threshold) + 1e-9
    possible = F.lit(False)
    for j in range(len(NORMS) - 1):
        possible = possible | (F.col(f"p{j + 1}") <= free * (F.col(f"p{j + 1}") + F.col(f"s{j}")))
    return ranked.where(possible).select("doc", "term", "df")


def candidate_pairs(found: DataFrame, threshold: float, probes: DataFrame | None = None) -> DataFrame:
    """left, right (left < right): pairs that may reach the threshold; with ``probes`` (doc), only those of a probe.

    Terms have one order (rarest first), so the first term that two documents share is in both their prefixes, and prefixes
    meet only prefixes. With probes, the plan starts from them: only their prefixes are made, which meet all terms. A threshold
    of 0 or less asks for all pairs, by definition.
    """
    if threshold <= 0:
        docs = found.select("doc").distinct()
        a, b = (probes if probes is not None else docs).select(F.col("doc").alias("a")), docs.select(F.col("doc").alias("b"))
        both = a.crossJoin(b)
    elif probes is None:
        own = prefixes(found, threshold)
        both = own.select(F.col("doc").alias("a"), "term").join(own.select(F.col("doc").alias("b"), "term"), "term").where("a < b")
    else:
        both = prefixes(found, threshold, probes).select(F.col("doc").alias("a"), "term").join(found.select(F.col("doc").alias("b"), "term"), "term")
    return both.where("a != b").select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).distinct()


def _hashed(docs: DataFrame, pattern: str = r"[\p{L}\p{N}]+") -> DataFrame:
    """doc, tokens: the 64-bit hashes of every document's tokens (one pair in 10^13 of large documents has two terms of one hash)."""
    return docs.select("doc", F.transform(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)), lambda w: F.xxhash64(w)).alias("tokens"))


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, sorted terms and their counts of every document of a batch that has a term."""
    column = batch.column("tokens")
    values, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    for row in range(batch.num_rows):
        if offsets[row + 1] > offsets[row]:
            yield row, *np.unique(values[offsets[row] : offsets[row + 1]], return_counts=True)


def _map_documents(docs: DataFrame, one, fields: list[t.StructField]) -> DataFrame:
    """doc and the ``fields`` that ``one`` makes of each document's terms and counts; documents without a term are left out."""
    tokens = _hashed(docs)
    schema = t.StructType([tokens.schema["doc"], *fields])
    arrow = {t.BinaryType(): pa.binary(), t.LongType(): pa.int64(), t.DoubleType(): pa.float64(), t.ArrayType(t.DoubleType()): pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, one(term, tf)) for row, term, tf in _counted(batch)]
            if found:
                made = [pa.array([x[k] for _, x in found], arrow[f.dataType]) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array([row for row, _ in found])), *made], names=schema.names)

    return tokens.mapInArrow(run, schema)


def vectors(docs: DataFrame) -> DataFrame:
    """doc, terms (sorted 64-bit hashes), tfs (32-bit) of every document (doc, text)."""
    return _map_documents(docs, lambda term, tf: (term.tobytes(), tf.astype(np.uint32).tobytes()), [t.StructField("terms", t.BinaryType()), t.StructField("tfs", t.BinaryType())])


def sketches(docs: DataFrame, threshold: float) -> DataFrame:
    """doc, n, size, missing, totals, bits of every document (doc, text).

    ``missing`` terms at most can be absent from a match: they weigh 1 - ``least_share`` of the document at most, and each at least
    what a single occurrence does; relative to that, the document weighs most at the largest length factor. ``totals`` are the
    squared weights at every factor of ``NORMS``; ``bits`` has a bit for each term's hash.
    """
    free = 1 - least_share(threshold) + 1e-9

    def one(term: np.ndarray, tf: np.ndarray) -> tuple:
        totals = [float(((tf * (K1 + 1) / (tf + norm)) ** 2).sum()) for norm in NORMS]
        missing = free * totals[-1] / ((K1 + 1) / (1 + MOST_NORM)) ** 2
        bits = np.zeros(BITS, bool)
        bits[(term % np.uint64(BITS)).astype(np.int64)] = True
        return len(term), float(tf.sum()), missing, totals, np.packbits(bits).tobytes()

    fields = [t.StructField("n", t.LongType()), t.StructField("size", t.DoubleType()), t.StructField("missing", t.DoubleType()), t.StructField("totals", t.ArrayType(t.DoubleType())), t.StructField("bits", t.BinaryType())]
    return _map_documents(docs, one, fields)


class _Side:
    """The sketches of some documents as arrays, ordered by their number of terms."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        self.n = batch.column("n").to_numpy().astype(float)
        order = np.argsort(self.n, kind="stable")
        self.n, self.rows = self.n[order], order
        self.size, self.missing = (batch.column(c).to_numpy()[order] for c in ("size", "missing"))
        self.probe, self.home = (batch.column(c).to_numpy(zero_copy_only=False)[order] for c in ("probe", "home"))
        self.totals = np.array(batch.column("totals").to_pylist()).reshape(-1, len(NORMS))[order]
        self.bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)[order]
        self.folded = np.ascontiguousarray(np.bitwise_or.reduce(self.bits.reshape(len(order), -1, FOLDED), axis=1).T)
        self.held = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.need = np.bitwise_count(self.folded).sum(0, dtype=np.int64) - np.floor(self.missing + 1e-6)


def _possible(one: _Side, i: np.ndarray, two: _Side, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) may reach the threshold, by the terms that each side must lack."""
    r = (IDF_SHARED / IDF_ONCE) ** 2
    both = np.bitwise_count(one.bits[i] & two.bits[j]).sum(1, dtype=np.int64)
    lack = [one.held[i] - both, two.held[j] - both]
    lack = [np.maximum(lack[0], one.n[i] - two.n[j] + lack[1]), np.maximum(lack[1], two.n[j] - one.n[i] + lack[0])]
    mean, shares = (one.size[i] + two.size[j]) / 2, []
    for side, k, without in ((one, i, lack[0]), (two, j, lack[1])):
        norm = K1 * (1 - B + B * side.size[k] / mean)
        step = np.clip(np.floor((norm - LEAST_NORM) / (NORMS[1] - NORMS[0]) - 1e-9).astype(int), 0, len(NORMS) - 1)  # totals are too large, never too small
        shares.append(np.clip(1 - without * ((K1 + 1) / (1 + norm)) ** 2 / side.totals[k, step], 0, 1))
    x, y = shares
    return r * np.sqrt(x * y / ((1 - (1 - r) * x) * (1 - (1 - r) * y))) >= threshold - 1e-9


def _near(visitors: _Side, homes: _Side, threshold: float, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (visitor, home) of the pairs that may reach the threshold; ``inside``: both sides are the same documents."""
    for k in range(len(visitors.n)):
        low = k + 1 if inside else np.searchsorted(homes.n, visitors.n[k] - visitors.missing[k] - 1e-6)
        high = np.searchsorted(homes.n, visitors.n[k] + homes.missing.max(initial=0) + 1e-6, "right") if inside else len(homes.n)
        shared = np.zeros(max(0, high - low), np.int16)
        for w in range(FOLDED):
            shared += np.bitwise_count(homes.folded[w, low:high] & visitors.folded[w, k])
        j = np.flatnonzero((shared >= visitors.need[k]) & (shared >= homes.need[low:high])) + low
        if not visitors.probe[k]:
            j = j[homes.probe[j]]
        for s in range(0, len(j), 20000):
            part = j[s : s + 20000]
            i = np.full(len(part), k)
            good = _possible(visitors, i, homes, part, threshold)
            if good.any():
                yield i[good], part[good]


def sketched_pairs(found: DataFrame, threshold: float, probes: DataFrame | None = None) -> DataFrame:
    """left, right (left < right): the pairs of sketches that may reach the threshold; with ``probes`` (doc), or where sketches are marked
    as ``probe``, only those of a probe.

    Bitmaps and numbers of terms bound what two documents can share, so no match is lost. Documents are dealt by their number of
    terms into ranges; each also visits those lower ranges that may hold a match.
    """
    marked = found if "probe" in found.columns else found.withColumn("probe", F.lit(True))
    own = marked if probes is None else found.join(probes.select("doc", F.lit(True).alias("probe")), "doc", "left").withColumn("probe", F.coalesce("probe", F.lit(False)))
    cuts = sorted(set(found.approxQuantile("n", [k / RANGES for k in range(1, RANGES)], 0.002)))

    def place(c: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= c)) if cuts else F.lit(0)

    dealt = own.withColumn("last", place(F.col("n"))).withColumn("block", F.explode(F.sequence(place(F.col("n") - F.col("missing") - F.lit(1e-6)), "last"))).withColumn("home", F.col("block") == F.col("last")).drop("last")
    schema = t.StructType([t.StructField(s, found.schema["doc"].dataType) for s in ("a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, held, block = None, [], None

        def pairs(table: pa.Table, inside: bool, side: _Side) -> Iterator[pa.RecordBatch]:
            doc = table.column("doc").combine_chunks()
            for i, j in _near(side, homes[0], threshold, inside):
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(side.rows[i])), homes[1].take(pa.array(homes[0].rows[j]))], names=["a", "b"])

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal homes, held
            if held:
                table = pa.Table.from_batches(held)
                side, held = _Side(table), []
                homes = (side, table.column("doc").combine_chunks())
                yield from pairs(table, True, side)

        for batch in batches:  # sorted by block, homes first
            keys = batch.column("block").to_numpy() * 2 + ~batch.column("home").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                at, home = part.column("block")[0].as_py(), part.column("home")[0].as_py()
                if at != block:
                    yield from ended()
                    homes, block = None, at
                if home:
                    held.append(part)
                    continue
                yield from ended()
                if homes is not None:
                    yield from pairs(pa.Table.from_batches([part]), False, _Side(part))
        yield from ended()

    sorted_ = dealt.repartition(RANGES, "block").sortWithinPartitions("block", F.desc("home"))
    return sorted_.mapInArrow(run, schema).select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"))


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc is in ``ids`` (doc), and some others: a map of ``MAP`` bits tells them, so that no text is dealt out."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(MAP)) + 1
    maps = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    own = docs.withColumn("bucket", F.bitmap_bucket_number(bit)).withColumn("place", F.bitmap_bit_position(bit))
    byte = F.expr("cast(conv(hex(substring(map, cast(place div 8 as int) + 1, 1)), 16, 10) as int)")
    return own.join(F.broadcast(maps), "bucket").where(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1).select(*docs.columns)


def scoring_cells(pairs: DataFrame) -> DataFrame:
    """left, right, cell: pairs that are scored together.

    A pair goes with the smallest document that its left one is paired with, so the documents of a cluster mostly meet in one cell, and
    each is sent there once, not once a pair; what would be more than ``CELL`` pairs is divided by the left document.
    """
    lead = both_ways(pairs).groupBy("doc").agg(F.min("peer").alias("peer")).select(F.col("doc").alias("left"), F.least("doc", "peer").alias("lead"))
    placed = pairs.select("left", "right").join(lead, "left")
    size = placed.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(size, "lead").select("left", "right", F.xxhash64("lead", F.pmod(F.xxhash64("left"), F.ceil(F.col("n") / CELL))).alias("cell"))


def _keys(column: pa.Array) -> list:
    """Documents' ids as keys, whether they are numbers or structs."""
    return list(zip(*(c.to_pylist() for c in column.flatten()), strict=True)) if pa.types.is_struct(column.type) else column.to_pylist()


def vector_scores(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, score of the pairs, by the vectors of their documents (doc, text); no terms are exploded into rows."""
    placed = materialise(scoring_cells(pairs), "metadata-cells")
    wanted = placed.select(F.col("left").alias("doc"), "cell").unionByName(placed.select(F.col("right").alias("doc"), "cell")).distinct()
    found = vectors(likely(docs, wanted)).dropDuplicates(["doc"])
    held = wanted.join(found, "doc").select("cell", F.lit(False).alias("pair"), F.col("doc").alias("left"), F.col("doc").alias("right"), "terms", "tfs")
    empty = F.lit(None).cast("binary")
    dealt = held.unionByName(placed.select("cell", F.lit(True).alias("pair"), "left", "right", empty.alias("terms"), empty.alias("tfs")))
    schema = t.StructType([pairs.schema["left"], pairs.schema["right"], t.StructField("score", t.DoubleType())])
    ratio = (IDF_SHARED / IDF_ONCE) ** 2

    def score(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
        mean = max((x.sum() + y.sum()) / 2, 1.0)
        u, v = (z * (K1 + 1) / (z + K1 * (1 - B + B * z.sum() / mean)) for z in (x, y))
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        p, q = u[i], v[j]
        return float(ratio * (p @ q) / math.sqrt((u @ u - (1 - ratio) * (p @ p)) * (v @ v - (1 - ratio) * (q @ q))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, vector = None, {}
        for batch in batches:  # sorted by cell, its documents first
            rows, scores = [], []
            columns = (batch.column("cell").to_pylist(), batch.column("pair").to_pylist(), _keys(batch.column("left")), _keys(batch.column("right")), batch.column("terms"), batch.column("tfs"))
            for row, (at, pair, l, r, term, tf) in enumerate(zip(*columns, strict=True)):
                if at != cell:
                    cell, vector = at, {}
                if not pair:
                    vector[l] = (np.frombuffer(term.as_py(), np.uint64), np.frombuffer(tf.as_py(), np.uint32).astype(float))
                elif l in vector and r in vector:  # a document without a term has no vector
                    rows.append(row)
                    scores.append(score(*vector[l], *vector[r]))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(s).take(pa.array(rows)) for s in ("left", "right")] + [pa.array(scores, pa.float64())], names=schema.names)

    return dealt.repartition("cell").sortWithinPartitions("cell", "pair").mapInArrow(run, schema)


def pair_scores(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, score of the pairs.

    A document's own norm depends on the pair's mean length, so it is summed from its histogram of term frequencies.
    """
    held = found.groupBy("doc", "tf").agg(F.count(F.lit(1)).alias("n")).groupBy("doc").agg(F.sum(F.col("tf") * F.col("n")).cast("double").alias("len"), F.collect_list(F.struct(F.col("tf").cast("double").alias("tf"), F.col("n").cast("double").alias("n"))).alias("histogram"))
    side = {s: held.select(F.col("doc").alias(s), F.col("len").alias(f"{s}_len"), F.sort_array("histogram").alias(f"{s}_histogram")) for s in ("left", "right")}
    own = pairs.join(side["left"], "left").join(side["right"], "right").withColumn("mean", (F.col("left_len") + F.col("right_len")) / 2)

    def norm(s: str) -> Column:
        def add(total: Column, x: Column) -> Column:
            w = weight(x["tf"], F.col(f"{s}_len"), F.col("mean"), IDF_ONCE)
            return total + x["n"] * w * w

        return F.aggregate(F.col(f"{s}_histogram"), F.lit(0.0), add)

    own = own.select("left", "right", "left_len", "right_len", "mean", norm("left").alias("left_norm"), norm("right").alias("right_norm"))
    l, r = (found.select(F.col("doc").alias(s), "term", F.col("tf").cast("double").alias(f"{s}_tf")) for s in ("left", "right"))
    shared = own.select("left", "right", "left_len", "right_len", "mean").join(l, "left").join(r, ["right", "term"])
    wl, wr = weight(F.col("left_tf"), F.col("left_len"), F.col("mean"), IDF_ONCE), weight(F.col("right_tf"), F.col("right_len"), F.col("mean"), IDF_ONCE)
    sums = shared.groupBy("left", "right").agg(F.sum(wl * wr).alias("dot"), F.sum(wl * wl).alias("l2"), F.sum(wr * wr).alias("r2"))
    ratio = (IDF_SHARED / IDF_ONCE) ** 2
    a, b = F.col("left_norm") - (1 - ratio) * F.col("l2"), F.col("right_norm") - (1 - ratio) * F.col("r2")
    return own.join(sums, ["left", "right"]).select("left", "right", (F.lit(ratio) * F.col("dot") / F.sqrt(a * b)).alias("score"))


def least_of_both(threshold: float) -> float:
    """What one document of a match, at least, shares of its squared weights: with less on both sides, the bound of ``least_share`` stays below."""
    r = (IDF_SHARED / IDF_ONCE) ** 2
    return threshold / (r + (1 - r) * threshold)


class _Vectors:
    """Vectors of some documents, one after the other: terms, counts (tf), and the document (of) of each entry."""

    def __init__(self, *parts: tuple[bytes, bytes, bytes]):
        """The parts: numbers of terms of their documents, terms, and counts of one, two or four bytes."""
        self.lengths = np.concatenate([np.frombuffer(lengths, np.uint32) for lengths, _, _ in parts]).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.terms = np.concatenate([np.frombuffer(terms, np.uint64) for _, terms, _ in parts])
        self.tf = np.concatenate([np.frombuffer(tfs, f"u{8 * len(tfs) // max(8, len(terms)) or 1}") for _, terms, tfs in parts]).astype(float)
        self.of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.size = np.bincount(self.of, self.tf, len(self.lengths))
        bits = np.zeros((len(self.lengths), BITS), bool)
        bits[self.of, (self.terms % np.uint64(BITS)).astype(np.int64)] = True
        self.bits = np.packbits(bits, axis=1).view(np.uint64)
        self.held = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.totals = np.stack([np.bincount(self.of, (self.tf * (K1 + 1) / (self.tf + norm)) ** 2, len(self.lengths)) for norm in NORMS], 1)
        self.n = self.lengths.astype(float)

    def rarest(self, often: np.ndarray, free: float) -> np.ndarray:
        """Entries that a match must share one of if it lacks at most ``free`` of its document's weights, rarest first (see ``prefixes``)."""
        order = np.argsort((self.of << 32) | often, kind="stable")  # within documents, so ``of`` stays as it is
        tf, possible, last = self.tf[order], np.zeros(len(order), bool), None
        for j in range(len(NORMS) - 1, -1, -2):
            w = (tf * (K1 + 1) / (tf + NORMS[j])) ** 2
            before = np.cumsum(w) - w
            before -= before[self.first].repeat(self.lengths)
            if last is not None:  # sums over many documents are rounded
                possible |= (1 - free) * last <= ((free + 1e-7) * self.totals[:, j]).repeat(self.lengths) - free * before
            last = before
        return order[possible]


def _spans(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every span, one span after the other."""
    return np.arange(times.sum()) + np.repeat(first - np.cumsum(times) + times, times)


class _Index:
    """The documents that hold each term, and those that hold it among their rarest."""

    def __init__(self, own: _Vectors, threshold: float):
        self.own, self.threshold = own, threshold
        self.free = 1 - least_of_both(threshold) + 1e-9
        self.terms, self.place, self.times = np.unique(own.terms, return_inverse=True, return_counts=True)
        self.all = self._postings(np.arange(len(own.of)))
        self.rare = self._postings(own.rarest(self.times[self.place], self.free))

    def _postings(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents of the entries by term; where those of each term begin, and how many they are."""
        times = np.bincount(self.place[entries], minlength=len(self.terms))
        return self.own.of[entries[np.argsort(self.place[entries], kind="stable")]], np.cumsum(times) - times, times

    def candidates(self, visitors: _Vectors, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (visitor, own) that may reach the threshold, each once, by visitor, of those that ``wanted`` (visitor, own) leaves.

        One of the two holds a shared term among its rarest. Terms that none of these documents holds are the rarest of all.
        """
        at = np.minimum(np.searchsorted(self.terms, visitors.terms), len(self.terms) - 1)
        hit = self.terms[at] == visitors.terms
        mine = visitors.rarest(np.where(hit, self.times[at], 0), self.free)
        looked = [(np.sort(mine[hit[mine]]), self.all), (np.flatnonzero(hit), self.rare)]
        work = sum(np.bincount(visitors.of[e], times[at[e]], len(visitors.n)) for e, (_, _, times) in looked)
        share = (np.cumsum(work) // VISITED).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(share)) + 1), len(work)]
        for s, e in zip(edges, edges[1:], strict=False):
            keys = []
            for entries, (docs, first, times) in looked:
                part = entries[np.searchsorted(visitors.of[entries], s) : np.searchsorted(visitors.of[entries], e)]
                n = times[at[part]]
                keys.append(np.repeat(visitors.of[part], n) * len(self.own.n) + docs[_spans(first[at[part]], n)])
            i, j = np.divmod(np.unique(np.concatenate(keys)), len(self.own.n))
            good = wanted(i, j)
            i, j = i[good], j[good]
            for k in range(0, len(i), CELL):
                good = _possible(visitors, i[k : k + CELL], self.own, j[k : k + CELL], self.threshold)
                yield i[k : k + CELL][good], j[k : k + CELL][good]

    def matches(self, visitors: _Vectors, wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Visitors, own documents and scores of the pairs that reach the threshold."""
        ratio, own = (IDF_SHARED / IDF_ONCE) ** 2, self.own
        dense = np.zeros(len(self.terms))
        for i, j in self.candidates(visitors, wanted):
            edges = [0, *(np.flatnonzero(np.diff(i)) + 1), len(i)] if len(i) else [0]
            for s, e in zip(edges, edges[1:], strict=False):
                mine = slice(visitors.first[i[s]], visitors.first[i[s]] + visitors.lengths[i[s]])
                term, tf, docs = visitors.terms[mine], visitors.tf[mine], j[s:e]
                at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
                hit = self.terms[at] == term
                dense[at[hit]] = tf[hit]
                size, mean = visitors.size[i[s]], np.maximum((own.size[docs] + visitors.size[i[s]]) / 2, 1)
                norm, other = K1 * (1 - B + B * size / mean), K1 * (1 - B + B * own.size[docs] / mean)
                value, often = np.unique(tf, return_counts=True)
                total = (often * (value * (K1 + 1) / (value + norm[:, None])) ** 2).sum(1)
                entry, of = _spans(own.first[docs], own.lengths[docs]), np.repeat(np.arange(e - s), own.lengths[docs])
                v = own.tf[entry] * (K1 + 1) / (own.tf[entry] + other[of])
                x = dense[self.place[entry]]
                theirs, both = np.bincount(of, v * v, e - s), x > 0
                x, v, of = x[both], v[both], of[both]
                u = x * (K1 + 1) / (x + norm[of])
                dot, l2, r2 = (np.bincount(of, w, e - s) for w in (u * v, u * u, v * v))
                dense[at[hit]] = 0
                score = ratio * dot / np.sqrt((total - (1 - ratio) * l2) * (theirs - (1 - ratio) * r2))
                good = score >= self.threshold - 1e-12
                if good.any():
                    yield i[s:e][good], docs[good], score[good]


def blocks(found: DataFrame, docs: DataFrame) -> DataFrame:
    """block, and the documents, numbers of terms, terms and counts of its probes and of its other documents, one after the other.

    ``found``: doc, terms, tfs, maybe with copies and with others; ``docs``: doc, probe of those that are taken. A block has about ``PART``
    documents, fewer where they are long.
    """
    parts = max(RANGES // 4, -(-docs.count() // PART))
    empty = F.lit(None).cast("binary")
    wanted = docs.select("doc", "probe", empty.alias("terms"), empty.alias("tfs"))
    dealt = wanted.unionByName(found.select("doc", F.lit(None).cast("boolean").alias("probe"), "terms", "tfs")).withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int"))
    kinds = [t.StructField("docs", t.ArrayType(docs.schema["doc"].dataType)), *(t.StructField(s, t.BinaryType()) for s in ("lengths", "terms", "tfs"))]
    schema = t.StructType([t.StructField("block", t.LongType()), *(t.StructField(f"{s}_{f.name}", f.dataType) for s in ("probe", "other") for f in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, entries, doc, probe = None, 0, 0, None, None
        held: list[list[tuple]] = [[], []]

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal number, entries
            if entries:
                columns = [pa.array([(part << 24) + number], pa.int64())]
                for rows in held:
                    ids = pa.concat_arrays([x for x, _, _ in rows]) if rows else nothing
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
                    counts = np.frombuffer(b"".join(tfs for _, _, tfs in rows), np.uint32)
                    counts = counts.astype(np.min_scalar_type(counts.max(initial=0)))
                    columns += [pa.array([x], pa.binary()) for x in (np.array([len(terms) // 8 for _, terms, _ in rows], np.uint32).tobytes(), b"".join(terms for _, terms, _ in rows), counts.tobytes())]
                    rows.clear()
                number, entries = number + 1, 0
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:  # sorted by part and document, what tells whether it is a probe first
            ids = batch.column("doc")
            nothing = ids.slice(0, 0)
            columns = (batch.column("part").to_pylist(), _keys(ids), batch.column("probe").to_pylist(), batch.column("terms").to_pylist(), batch.column("tfs").to_pylist())
            for row, (at, key, kind, terms, tfs) in enumerate(zip(*columns, strict=True)):
                if at != part:
                    yield from ended()
                    part, number, doc = at, 0, None
                if terms is None:
                    doc, probe = key, kind
                elif key == doc:
                    held[not probe].append((ids.slice(row, 1), terms, tfs))
                    entries, doc = entries + len(terms) // 8, None  # its copies are left out
                    if entries > ENTRIES:
                        yield from ended()
        yield from ended()

    return dealt.repartition(parts, "part").sortWithinPartitions("part", "doc", F.col("terms").isNotNull()).mapInArrow(run, schema)


def probe_scores(texts: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """left, right (left < right), score of every pair of ``docs`` (doc, probe) with a probe that reaches the threshold.

    ``texts``: doc, text, maybe with copies and with others. For thresholds so low that sketches rule out too little by one side: every
    block indexes its documents and is visited by the probes of every block, which are read where they are and not dealt out.
    """
    made = materialise(blocks(vectors(likely(texts, docs)), docs), "metadata-blocks", "none")  # hashes don't shrink
    # a file a block: probes of some blocks are read together, so that a block's index is made once for them
    visits = made.where(F.size("probe_docs") > 0).select(F.col("block").alias("visits"), *(F.col(f"probe_{s}").alias(f"visit_{s}") for s in ("docs", "lengths", "terms", "tfs")))
    both = made.crossJoin(visits.coalesce(max(1, visits.rdd.getNumPartitions() // TOGETHER)))
    schema = t.StructType([t.StructField("a", docs.schema["doc"].dataType), t.StructField("b", docs.schema["doc"].dataType), t.StructField("score", t.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, ids, probes = None, None, None, 0
        for batch in batches:
            for row in range(batch.num_rows):  # by block
                x = {s: batch.column(s)[row] for s in batch.schema.names}
                if x["block"].as_py() != block:
                    block, probes, index = x["block"].as_py(), len(x["probe_docs"]), None  # the former one goes before
                    index = _Index(_Vectors(*(tuple(x[f"{k}_{s}"].as_py() for s in ("lengths", "terms", "tfs")) for k in ("probe", "other"))), threshold)
                    ids = pa.concat_arrays([x["probe_docs"].values, x["other_docs"].values])
                at, visitors = x["visits"].as_py(), _Vectors(tuple(x[f"visit_{s}"].as_py() for s in ("lengths", "terms", "tfs")))
                # two probes meet in one of their blocks only
                for i, j, score in index.matches(visitors, lambda i, j, at=at: (j >= probes) | (at < block) | ((at == block) & (i < j))):
                    yield pa.RecordBatch.from_arrays([x["visit_docs"].values.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score)], names=schema.names)

    scores = materialise(both.mapInArrow(run, schema).select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), "score"), "metadata-scores")
    discard(made)
    return scores

def marked(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """doc, probe: which of the documents are probes; written, as it is read several times."""
    return materialise(docs.join(probes.withColumn("probe", F.lit(True)), "doc", "left").withColumn("probe", F.coalesce("probe", F.lit(False))), "metadata-probes")


def classes(docs: DataFrame) -> DataFrame:
    """doc, rep: documents of equal text stand behind the smallest of them."""
    own = docs.select("doc", F.sha2(F.col("text").cast("binary"), 256).alias("text"))  # the texts themselves are not dealt out
    first = own.groupBy("text").agg(F.min("doc").alias("rep"))
    return own.join(first, "text").select("doc", "rep")


def matches(docs: DataFrame, threshold: float, probes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(left, right, score) between representatives of different texts at or above the threshold, and the membership (doc, rep).

    ``docs``: doc, text. Equal texts always match one another, with score 1; they are not expanded into pairs, and no link
    between different texts is lost: every member has the links of its representative. With ``probes`` (doc), only pairs with the
    text of a probe are found, starting from the probes. Pairs without a common term score 0, so only a threshold of 0 or less
    has them. Null texts match nothing.
    """
    member = classes(docs.where(F.col("text").isNotNull()))
    if threshold > 0 and least_share(threshold) >= SKETCHED:
        member = materialise(member, "metadata-members")
        found = materialise(sketches(docs, threshold).join(member.where("doc = rep").select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"]), "metadata-sketches")
        own = member.join(probes, "doc", "left_semi").select(F.col("rep").alias("doc")).distinct() if probes is not None else None
        return sketched_scores(docs, found, threshold, own), member
    if threshold > 0 and probes is not None:
        member = materialise(member, "metadata-members")
        own = member.join(probes, "doc", "left_semi").select(F.col("rep").alias("doc")).distinct()
        return probe_scores(docs, marked(member.where("doc = rep").select("doc").distinct(), own), threshold), member
    distinct = docs.join(member.where("doc = rep"), "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text"))
    found = materialise(terms(distinct), "metadata-terms")  # read by several branches of the plan
    own = member.join(probes, "doc", "left_semi").select(F.col("rep").alias("doc")).distinct() if probes is not None else None
    pairs = materialise(candidate_pairs(found, threshold, own), "metadata-candidates")
    scored = pair_scores(found, pairs)
    if threshold <= 0:
        scored = pairs.join(scored, ["left", "right"], "left").select("left", "right", F.coalesce("score", F.lit(0.0)).alias("score"))
    return scored.where(F.col("score") >= threshold - 1e-12), member


def sketched_scores(docs: DataFrame, found: DataFrame, threshold: float, probes: DataFrame | None = None) -> DataFrame:
    """left, right, score of the documents (doc, text) that have one of the sketches ``found``, which are deleted."""
    pairs = materialise(sketched_pairs(found, threshold, probes), "metadata-candidates")
    discard(found)
    return materialise(vector_scores(docs, pairs).where(F.col("score") >= threshold - 1e-12), "metadata-scores")


def expanded(pairs: DataFrame, member: DataFrame, probes: DataFrame) -> DataFrame:
    """probe, other, score: what each probe matches, copies on both sides included. The probes are a stated query set."""
    own = member.join(probes, "doc", "left_semi").select(F.col("doc").alias("probe"), F.col("rep").alias("a"))
    both = pairs.select(F.col("left").alias("a"), F.col("right").alias("b"), "score").unionByName(pairs.select(F.col("right").alias("a"), F.col("left").alias("b"), "score"))
    same = own.select("probe", F.col("a").alias("b"), F.lit(1.0).alias("score"))
    reached = own.join(both, "a").select("probe", "b", "score").unionByName(same)
    return reached.join(member.select(F.col("doc").alias("other"), F.col("rep").alias("b")), "b").where("probe != other").select("probe", "other", "score")


def anchors(nft: DataFrame, what: str = "body", name: str = "text") -> DataFrame:
    """member, contract, chain, token_key, text, nfts: the metadata (or another column, by that name) of every token of every member.

    A member is an EVM contract or a Solana NFT. ``contract`` holds the chain, too; of rows that repeat a token the last counts.
    """
    contract = F.concat("chain", F.lit("/"), "contract")
    member = F.when(F.col("chain") == "solana", F.concat(contract, F.lit("/"), F.col("token_id"))).otherwise(contract)
    own = nft.where(F.col("body").isNotNull()).groupBy(member.alias("member"), contract.alias("contract"), "chain", "token_id").agg(F.max_by(what, "row_order").alias(name), F.count(F.lit(1)).alias("nfts"))
    return own.select("member", "contract", "chain", token_key(F.col("token_id")).alias("token_key"), name, "nfts")


def with_documents(own: DataFrame) -> DataFrame:
    """Anchors with ``doc``, a number for each different text (two hashes, so that none need be counted or sorted)."""
    return own.withColumn("doc", document_number("text"))


def document_number(text: str) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.crc32(F.col(text).cast("binary")).alias("b"))


def numbered(nft: DataFrame) -> DataFrame:
    """The snapshot with ``doc``, the number of each NFT's document: anchors can hold the number, and the texts stay where they are."""
    return nft.withColumn("doc", document_number("body"))


def numbered_links(nft: DataFrame, own: DataFrame, threshold: float, probes: DataFrame | None = None) -> DataFrame:
    """``document_links`` of anchors with ``doc`` only; the texts are read where they are in the snapshot."""
    texts = numbered(nft.where(F.col("body").isNotNull())).select("doc", F.col("body").alias("text"))
    docs = own.select("doc").distinct()
    if threshold <= 0 or least_share(threshold) < SKETCHED:
        return document_links(texts.join(docs, "doc", "left_semi"), threshold, probes)
    if probes is not None:  # marked here, so that the sketches need not be dealt out again for it
        docs = docs.join(probes.select("doc", F.lit(True).alias("probe")).distinct(), "doc", "left").withColumn("probe", F.coalesce("probe", F.lit(False)))
    found = materialise(sketches(texts, threshold).dropDuplicates(["doc"]).join(docs, "doc"), "metadata-sketches")
    return both_ways(sketched_scores(texts, found, threshold))


def both_ways(pairs: DataFrame) -> DataFrame:
    """doc, peer: the pairs in both orders."""
    return pairs.select(F.col("left").alias("doc"), F.col("right").alias("peer")).unionByName(pairs.select(F.col("right").alias("doc"), F.col("left").alias("peer")))


def member_pairs(own: DataFrame, links: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """left, right: members of different contracts whose chosen documents match (left < right; or left one of ``left``: member).

    ``own``: anchors with ``doc``; ``links``: doc, peer of every ordered pair of different matching documents. Two EVM members are
    compared on their largest shared token, if they have one; otherwise, and with any other chain, each on its largest. Only
    members that have matching documents so placed are looked at, which loses none.
    """
    link = links.select(F.col("doc").alias("l_doc"), F.col("peer").alias("r_doc")).unionByName(own.select(F.col("doc").alias("l_doc"), F.col("doc").alias("r_doc")).distinct())
    columns = ("member", "contract", "chain", "doc", "token_key")
    first = own if left is None else own.join(left, "member", "left_semi")

    def side(frame: DataFrame, s: str) -> DataFrame:
        return frame.select(*(F.col(c).alias(f"{s}_{c}") for c in columns))

    def tops(frame: DataFrame, s: str) -> DataFrame:
        return side(frame.groupBy("member").agg(F.max_by(F.struct(*columns[1:]), "token_key").alias("t")).select("member", "t.*"), s)

    order = F.col("l_member") < F.col("r_member") if left is None else F.col("l_member") != F.col("r_member")
    both = order & (F.col("l_contract") != F.col("r_contract"))
    evm = (F.col("l_chain") != "solana") & (F.col("r_chain") != "solana")
    pair = ["l_member", "r_member"]
    by_token = side(first.where("chain != 'solana'"), "l").join(link, "l_doc").join(side(own.where("chain != 'solana'"), "r").withColumnRenamed("r_token_key", "l_token_key"), ["r_doc", "l_token_key"]).where(both & evm).select(*pair, F.col("l_token_key").alias("token_key"))
    by_token = materialise(by_token, "member-pairs-by-token")  # read by several branches of the plan, as the next
    by_top = materialise(tops(first, "l").join(link, "l_doc").join(tops(own, "r"), "r_doc").where(both).select(*pair, evm.alias("evm")), "member-pairs-by-top")
    pairs = by_token.select(*pair).unionByName(by_top.where("evm").select(*pair)).distinct()
    token = own.select("member", "token_key")
    shared = pairs.join(token.withColumnRenamed("member", "l_member"), "l_member").join(token.withColumnRenamed("member", "r_member"), ["r_member", "token_key"])
    largest = shared.groupBy(*pair).agg(F.max("token_key").alias("largest"))
    aligned = by_token.join(largest, pair).where("token_key = largest").select(*pair)
    lone = by_top.where("evm").join(largest, pair, "left_anti").select(*pair)
    return aligned.unionByName(lone).unionByName(by_top.where("not evm").select(*pair)).distinct().select(F.col("l_member").alias("left"), F.col("r_member").alias("right"))


def contract_pairs(own: DataFrame, links: DataFrame, left: DataFrame) -> DataFrame:
    """left, right: the contracts of ``member_pairs``, left one of ``left`` (contract). A Solana contract's NFTs are not paired one by one:
    pairs with them depend on the largest documents only, of which a contract's different ones are taken.
    """
    evm = own.where("chain != 'solana'")
    alike = member_pairs(evm, links, left.withColumnRenamed("contract", "member"))
    top = own.groupBy("member", "contract", "chain").agg(F.max_by("doc", "token_key").alias("doc")).select("contract", "doc", (F.col("chain") == "solana").alias("solana")).distinct()
    top = materialise(top, "contract-documents")
    l, r = (top.select(F.col("contract").alias(s), F.col("doc").alias(f"{s}_doc"), F.col("solana").alias(f"{s}_solana")) for s in ("left", "right"))
    link = links.select(F.col("doc").alias("left_doc"), F.col("peer").alias("right_doc")).unionByName(top.select(F.col("doc").alias("left_doc"), F.col("doc").alias("right_doc")).distinct())
    mixed = l.join(left.withColumnRenamed("contract", "left"), "left", "left_semi").join(link, "left_doc").join(r, "right_doc").where("left != right and (left_solana or right_solana)")
    return alike.unionByName(mixed.select("left", "right")).distinct()


def token_pairs(own: DataFrame, left: DataFrame) -> DataFrame:
    """left, right, left_doc, right_doc: EVM contracts, left one of ``left`` (contract), and the documents on which they are compared.

    ``own``: anchors with ``doc``. These are all pairs of contracts (their NFTs are not paired): one document is scored for each.
    """
    k = F.col("token_key")
    key = F.concat(k["other"].cast("string"), F.lpad(k["digits"].cast("string"), 10, "0"), F.when(k["other"] == 0, k["text"]).otherwise(""), k["raw"])  # sorted like token_key
    held = own.where("chain != 'solana'").groupBy("member", "contract").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), "doc"))).alias("tokens"))
    held = materialise(held.select("member", "contract", F.col("tokens.key").alias("keys"), F.col("tokens.doc").alias("docs")), "member-tokens")
    l, r = (frame.select(*(F.col(c).alias(f"{s}_{c}") for c in held.columns)) for s, frame in (("l", held.join(left, "contract", "left_semi")), ("r", held)))
    both = l.crossJoin(r).where("l_contract != r_contract").withColumn("largest", F.array_max(F.array_intersect("l_keys", "r_keys")))

    def doc(s: str) -> Column:
        return F.when(F.col("largest").isNull(), F.element_at(f"{s}_docs", -1)).otherwise(F.element_at(f"{s}_docs", F.array_position(f"{s}_keys", F.col("largest")).cast("int")))

    return both.select(F.col("l_member").alias("left"), F.col("r_member").alias("right"), doc("l").alias("left_doc"), doc("r").alias("right_doc"))


def seed_pairs(nft: DataFrame, own: DataFrame, threshold: float, left: DataFrame) -> DataFrame:
    """left, right: the pairs of ``member_pairs``, left one of the contracts ``left`` (contract), for low thresholds.

    ``own``: anchors with ``doc`` only. Only documents on which members are compared are scored: pairs with a Solana NFT depend on the
    largest document of each side, and of two EVM contracts one pair of documents counts.
    """
    texts = numbered(nft.where(F.col("body").isNotNull())).select("doc", F.col("body").alias("text"))
    top = materialise(own.groupBy("member", "contract", "chain").agg(F.max_by("doc", "token_key").alias("doc")), "member-documents")
    first = top.join(left, "contract", "left_semi")
    docs = marked(top.select("doc").distinct(), first.select("doc").distinct())
    links = probe_scores(texts, docs, threshold)
    link = both_ways(links).unionByName(docs.select("doc", F.col("doc").alias("peer")))
    l, r = (frame.select(*(F.col(c).alias(f"{s}_{c}") for c in top.columns)) for s, frame in (("l", first), ("r", top)))
    mixed = l.join(link.select(F.col("doc").alias("l_doc"), F.col("peer").alias("r_doc")), "l_doc").join(r, "r_doc").where("l_contract != r_contract and (l_chain = 'solana' or r_chain = 'solana')")

    pairs = materialise(token_pairs(own, left), "member-pairs")
    a, b = F.col("left_doc"), F.col("right_doc")
    chosen = pairs.where(a != b).select(F.least(a, b).alias("left"), F.greatest(a, b).alias("right")).distinct()
    near = vector_scores(texts, materialise(chosen, "metadata-candidates")).where(F.col("score") >= threshold - 1e-12)
    alike = pairs.join(both_ways(near).select(F.col("doc").alias("left_doc"), F.col("peer").alias("right_doc")), ["left_doc", "right_doc"]).unionByName(pairs.where(a == b).select("left_doc", "right_doc", "left", "right"))
    return mixed.select(F.col("l_member").alias("left"), F.col("r_member").alias("right")).unionByName(alike.select("left", "right"))


def document_links(own: DataFrame, threshold: float, probes: DataFrame | None = None) -> DataFrame:
    """doc, peer: ordered pairs of different matching documents of the anchors; with ``probes`` (doc), those of a probe."""
    return both_ways(matches(own.select("doc", "text"), threshold, probes)[0])


def metadata_hits(nft: DataFrame, threshold: float) -> DataFrame:
    """chain, contract, member, nfts, peer: every chain in which another contract's member matches this one.

    No pairs are made of members with equal documents. EVM contracts with equal anchors are one profile, and profiles are paired;
    pairs with a Solana NFT depend only on the largest document of each side, so chains are counted by document.
    """
    own = materialise(anchors(numbered(nft), "doc", "doc"), "metadata-anchors")
    links = materialise(numbered_links(nft, own, threshold), "metadata-links")
    size = own.groupBy("member", "contract", "chain").agg(F.sum("nfts").alias("nfts"), F.max_by("doc", "token_key").alias("doc"))

    # EVM contracts: by profile. Equal sets of anchors have equal counts, sums and xors of their hashes
    evm = own.where("chain != 'solana'")
    h = F.xxhash64("token_key", "doc")
    profile = evm.groupBy("member", "chain").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("doc", "token_key")).alias("x")).alias("profile"))
    profile = materialise(profile, "metadata-profiles")
    first = profile.groupBy("profile").agg(F.min("member").alias("member"))
    # members of one profile are different contracts; a profile's representative stands for all
    pairs = member_pairs(evm.join(first.select("member"), "member", "left_semi"), links)
    pairs = pairs.unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right"))).unionByName(first.select(F.col("member").alias("left"), F.col("member").alias("right")))
    held = profile.join(first.withColumnRenamed("member", "rep"), "profile").select("member", "chain", "rep")
    chains = held.groupBy(F.col("rep").alias("right"), F.col("chain").alias("peer")).agg(F.count(F.lit(1)).alias("n"))
    near = held.withColumnRenamed("rep", "left").join(pairs.join(chains, "right"), "left").where("left != right or peer != chain or n > 1").select("member", "peer")

    # with a Solana NFT on either side: by the largest documents; the NFTs of one contract don't match one another
    link = links.unionByName(size.select("doc", F.col("doc").alias("peer")).distinct()).withColumnRenamed("peer", "other_doc")
    there = size.groupBy(F.col("doc").alias("other_doc"), F.col("chain").alias("peer")).agg(F.countDistinct("contract").alias("n"), F.min("contract").alias("only"))
    mixed = size.join(link, "doc").join(there, "other_doc").where("(chain = 'solana' or peer = 'solana') and (n > 1 or only != contract)").select("member", "peer")
    return size.join(near.unionByName(mixed).distinct(), "member").select("chain", "contract", "member", "nfts", "peer")


def aligned_documents(anchors: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, left_doc, right_doc: the documents on which two contracts are compared.

    ``anchors``: contract, chain, token_key, doc. Two EVM contracts are compared on their largest shared token; without one, and
    with any other chain, each side's largest token counts.
    """
    top = anchors.groupBy("contract", "chain").agg(F.max_by("doc", "token_key").alias("doc"))
    l, r = top.select(F.col("contract").alias("left"), F.col("chain").alias("lc"), F.col("doc").alias("l_top")), top.select(F.col("contract").alias("right"), F.col("chain").alias("rc"), F.col("doc").alias("r_top"))
    la, ra = anchors.select(F.col("contract").alias("left"), "token_key", F.col("doc").alias("l_doc")), anchors.select(F.col("contract").alias("right"), "token_key", F.col("doc").alias("r_doc"))
    shared = pairs.join(la, "left").join(ra, ["right", "token_key"]).groupBy("left", "right").agg(F.max_by(F.struct("l_doc", "r_doc"), "token_key").alias("s"))
    evm = (F.col("lc") != "solana") & (F.col("rc") != "solana") & F.col("s").isNotNull()
    return pairs.join(l, "left").join(r, "right").join(shared, ["left", "right"], "left").select("left", "right", F.when(evm, F.col("s.l_doc")).otherwise(F.col("l_top")).alias("left_doc"), F.when(evm, F.col("s.r_doc")).otherwise(F.col("r_top")).alias("right_doc"))


assert math.isclose(LEAST_NORM, 0.3) and math.isclose(MOST_NORM, 2.1)
