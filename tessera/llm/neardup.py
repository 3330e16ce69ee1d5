"""Operator 5, near-duplicates by MinHash with tensored banding.

1. A document's set is its distinct five-word shingles, as 64-bit hashes. Documents with equal sets form a class; only one
   document of a class goes on.
2. Two collections of ``m`` small sketches, each of ``R`` minhashes, are computed. A table key combines a sketch of the first
   collection with one of the second: ``m * m`` tables of ``2 R`` minhashes from ``2 m`` sketches. Two sets of similarity t
   share a key unless all sketches of one collection differ: at most 2 (1 - t^R)^m, which m keeps under ``MISS``.
   A key can only be shared if both of its halves are, so halves that only one class has are dropped before pairs of halves
   are formed; that loses nothing.
3. Every class is tied to the smallest class of each of its keys. Components of these ties are clusters of candidates.
4. Inside a cluster the full sets, made again from the texts, are compared exactly, all against all by counting shared
   shingles over an inverted index. Large clusters are split into blocks. Every block is first compared with some pivots of
   the cluster, which ties most copies of one text together; pairs inside the largest component so found need no further
   look, so only the documents outside it are compared with all blocks. Each block pair is a task of its own and holds a
   bounded number of shingles and members however large a cluster is. A task passes on a spanning forest of its links.
5. Components of the confirmed links are the result.

Defined results: null texts and texts without words have an empty set and are linked with nothing; fewer than five words
are one shingle; rows that share a doc_id share a component; rows with a null doc_id are linked with nothing and are kept;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import CACHE_WORDS, chunks, mix
from tessera.llm.components import components
from tessera.runtime import materialise, ship_package

#: Words of a shingle, minhashes of a small sketch, chance to miss a pair at the threshold.
WORDS, R, MISS = 5, 5, 1e-5
#: Shingles and members that a block of a cluster holds (a comparing task holds two blocks, and its work grows with their
#: product), and pivots of a large cluster.
BLOCK_SHINGLES, BLOCK_MEMBERS, PIVOTS = 500_000, 200, 16
#: Candidate documents that are sent to all tasks with their cluster; beyond that they are joined.
SMALL = 1_000_000
#: Shingles that are minhashed at a time.
COLUMNS = 4096


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, memory: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text. Splitting bytes cuts at blank and the control characters 9 to 13."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def sketches_needed(threshold: float) -> int:
    """Sketches in each collection."""
    return max(1, math.ceil(math.log(MISS / 2) / math.log1p(-min(threshold, 0.999) ** R)))


class Sketcher:
    """The 2 m small sketches of a set."""

    def __init__(self, m: int) -> None:
        rng = np.random.default_rng(5)
        self.m = m
        self.a = rng.integers(0, 2**32, 2 * m * R, dtype=np.uint32)[:, None] | np.uint32(1)
        self.b = rng.integers(0, 2**32, 2 * m * R, dtype=np.uint32)[:, None]
        self.power = mix(np.arange(R, dtype=np.uint64) + np.uint64(3)) | np.uint64(1)
        self.place = mix(np.arange(2 * m, dtype=np.uint64) + np.uint64(1 << 32))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)[None, :]
        least = None
        for at in range(0, x.shape[1], COLUMNS):
            now = (x[:, at : at + COLUMNS] * self.a + self.b).min(axis=1)
            least = now if least is None else np.minimum(least, now)
        parts = least.astype(np.uint64).reshape(2 * self.m, R)
        return mix((parts * self.power).sum(axis=1, dtype=np.uint64) + self.place).view(np.int64)


def sets(docs: DataFrame, m: int) -> DataFrame:
    """doc_id, n_shingles, two 64-bit digests of the set, and the halves of its keys (first m: collection one)."""

    def run(batches):
        memory, sketch = WordHashes(), Sketcher(m)
        for rest, texts in chunks(batches, limit=2_000_000):
            if len(memory) > CACHE_WORDS:
                memory.clear()
            n, d1, d2, halves = [], [], [], []
            for t in texts:
                s = shingles(t, memory)
                raw = s.tobytes()
                n.append(len(s))
                d1.append(xxhash.xxh64_intdigest(raw, seed=1) - 2**63)
                d2.append(xxhash.xxh64_intdigest(raw, seed=2) - 2**63)
                halves.append(sketch(s) if len(s) else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, halves)])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rest["doc_id"], pa.int64()), "n_shingles": pa.array(n, pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "halves": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(halves) if halves else np.zeros(0, np.int64), pa.int64()))})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, halves array<long>")


def ties(found: DataFrame, m: int) -> DataFrame:
    """u, v: every class representative with the smallest one that shares a tensored key."""
    reps = found.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    own = found.join(reps, ["doc_id", "d1", "d2", "n_shingles"], "left_semi").select(F.col("doc_id").alias("node"), F.posexplode("halves").alias("p", "half"))
    own = own.distinct()  # of repeated rows
    shared = own.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    # a node has 2 m halves at most
    halves = own.join(shared, "half").groupBy("node").agg(F.collect_list(F.when(F.col("p") < m, F.col("half"))).alias("a"), F.collect_list(F.when(F.col("p") >= m, F.col("half"))).alias("b"))
    keys = halves.where("size(a) > 0 and size(b) > 0").select("node", F.explode("a").alias("x"), "b").select("node", "x", F.explode("b").alias("y")).select("node", F.xxhash64("x", "y").alias("key"))
    keys = materialise(keys, "tensored-keys")
    first = keys.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "v")
    return keys.join(first, "key").where("node != v").select(F.col("node").alias("u"), "v").distinct()


def linked(size_a: np.ndarray | int, size_b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (size_a + size_b - both)


def forest(nodes: list[int], own: list[np.ndarray], other: list[bool] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets. With ``other``, only sets of the two kinds are compared."""
    n = len(nodes)
    sizes = np.fromiter(map(len, own), np.int64, n)
    terms, number = np.unique(np.concatenate(own), return_inverse=True)
    who = np.repeat(np.arange(n), sizes)
    kind = np.array(other) if other is not None else None
    held = np.ones(len(who), bool) if kind is None else kind[who]
    df = np.bincount(number[held], minlength=len(terms))
    order = np.argsort(number[held], kind="stable")
    posting = who[held][order]
    first = np.concatenate([[0], np.cumsum(df)])
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    ends = np.cumsum(sizes)
    least_df = 1 if kind is None else 0
    for i in range(n):
        if kind is not None and kind[i]:
            continue
        t = number[ends[i] - sizes[i] : ends[i]]
        t = t[df[t] > least_df]
        if not len(t):
            continue
        spans = df[t]
        at = np.repeat(first[t] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
        both = np.bincount(posting[at], minlength=n)
        hit = np.flatnonzero(linked(int(sizes[i]), sizes, both, percent) & (both > 0))
        for j in hit.tolist():
            if j != i and (kind is not None or j < i):
                a, b = root(i), root(j)
                if a != b:
                    parent[a] = b
                    if nodes[i] != nodes[j]:
                        out.append((nodes[i], nodes[j]))
    return out


def compared(dealt: DataFrame, percent: int) -> DataFrame:
    """u, v: links inside each task (cluster, i, j), the ``turn``-th of its cluster, of rows (node, text, second).

    With i = j all sets of the task are compared with one another, else those of the first kind with those of the second.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        task: tuple | None = None
        nodes: list[int] = []
        own_sets: list[np.ndarray] = []
        second: list[bool] = []
        links: list[tuple[int, int]] = []

        def close() -> None:
            if len(nodes) > 1:
                links.extend(forest(nodes, own_sets, second if task[1] != task[2] else None, percent))
            nodes.clear(), own_sets.clear(), second.clear()

        for rest, texts in chunks(batches, limit=2_000_000):
            if len(memory) > CACHE_WORDS:
                memory.clear()
            for k, text in enumerate(texts):
                now = rest["cluster"][k], rest["i"][k], rest["j"][k]
                if now != task:
                    close()
                    task = now
                s = shingles(text, memory)
                if len(s):
                    nodes.append(rest["node"][k]), own_sets.append(s), second.append(rest["second"][k])
            yield pa.RecordBatch.from_arrays([pa.array([e[j] for e in links], pa.int64()) for j in (0, 1)], ["u", "v"])
            links.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([e[j] for e in links], pa.int64()) for j in (0, 1)], ["u", "v"])

    rows = dealt.select("node", "text", "cluster", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "second", "turn")
    # the tasks of one cluster go to the partitions in turn, so none gets many of them by chance
    parts = max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionById(parts, F.pmod(F.xxhash64("cluster") + F.col("turn"), F.lit(parts)).cast("int")).drop("turn")
    return rows.sortWithinPartitions("cluster", "i", "j", "node").mapInArrow(run, "u long, v long")


def confirmed(docs: DataFrame, clusters: DataFrame, sizes: DataFrame, percent: int, small: int, block: int) -> DataFrame:
    """u, v: links between the members of each cluster, checked on full sets."""
    member = clusters.select(F.col("node"), F.col("component").alias("cluster")).join(sizes, "node")

    def pieces() -> Column:
        return F.greatest(F.ceil(F.sum("n") / F.lit(block)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_MEMBERS))).cast("int")

    total = member.groupBy("cluster").agg(pieces().alias("blocks"))
    member = materialise(member.join(total, "cluster").withColumn("b", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))

    def with_text(tasks: DataFrame) -> DataFrame:
        """Tasks (node, cluster, i, j, second, turn) with the texts; the small side goes to all tasks only up to a measured size."""
        return texts.join(F.broadcast(tasks) if tasks.count() <= small else tasks, "node")

    no = F.lit(False)
    links = compared(with_text(member.where("blocks = 1").select("node", "cluster", F.lit(0).alias("i"), F.lit(0).alias("j"), no.alias("second"), F.lit(0).alias("turn"))), percent)
    large = member.where("blocks > 1")
    if not large.limit(1).count():
        return links

    # every block against the cluster's pivots (a limit of the window keeps few rows of a cluster before the shuffle)
    first = Window.partitionBy("cluster").orderBy(F.xxhash64("node", "cluster"), "node")
    pivots = large.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PIVOTS)
    tasks = large.select("node", "cluster", F.lit(-1).alias("i"), F.col("b").alias("j"), no.alias("second"))
    tasks = tasks.unionByName(pivots.select("node", "cluster", F.lit(-1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("second")))
    tied = materialise(compared(with_text(materialise(tasks.withColumn("turn", F.col("j")), "pivot-tasks")), percent), "pivot-links")
    links = links.unionByName(tied)

    # what is outside the cluster's largest component, against all blocks
    state = large.join(components(tied, "pivot-components"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    main = state.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("cluster").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    outside = materialise(state.join(main, "cluster").where("component != main").select("node", "cluster", "n", "b", "blocks"), "outside")
    rounds = outside.groupBy("cluster").agg(pieces().alias("groups"))
    mine = outside.join(rounds, "cluster").withColumn("i", F.pmod(F.xxhash64("node"), "groups").cast("int"))
    offset = 1 << 30  # tells the second kind's blocks from the first kind's
    tasks = mine.select("node", "cluster", "blocks", "i", F.explode(F.sequence(F.lit(offset), F.col("blocks") - 1 + offset)).alias("j"), no.alias("second"))
    tasks = tasks.unionByName(large.join(rounds, "cluster").select("node", "cluster", "blocks", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i"), (F.col("b") + offset).alias("j"), F.lit(True).alias("second")))
    tasks = tasks.withColumn("turn", F.col("i").cast("long") * F.col("blocks") + F.col("j") - offset).drop("blocks")
    return links.unionByName(compared(with_text(materialise(tasks, "outside-tasks")), percent))


def near_duplicates(docs: DataFrame, percent: int = 85, small: int = SMALL, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links need ``percent`` per cent of the union shared."""
    ship_package(docs.sparkSession)
    m = sketches_needed(percent / 100)
    found = materialise(sets(docs, m), "shingle-sets")
    clusters = components(ties(found, m), "candidate-clusters")
    sizes = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("n"))
    links = confirmed(docs, clusters, sizes, percent, small, block)
    # rows of one class are linked through its smallest id; rows of one id are one document
    # (a class may hold a third of all rows: with both sides of the join read from files, Spark can split its partition)
    classes = materialise(found.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    rows = materialise(found.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep"), "class-members")
    repeated = rows.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b")
    more = repeated.select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = components(links.unionByName(more), "confirmed-links")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), F.col("rep"), F.col("doc_id")))
    return rows.join(joined, rows["rep"] == joined["node"], "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, percent: int = 80, small: int = SMALL, block: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates: one of each component, the smallest id.

    Rows without words and rows with a null id stay. Of rows that share an id, the one whose text sorts first stays.
    """
    found = materialise(near_duplicates(docs, percent, small, block), "near-duplicates")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    twice = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    gone_side = F.broadcast(gone) if gone.count() <= small else gone
    repeated = twice.count()
    kept = docs.join(gone_side, "doc_id", "left_anti")
    if not repeated:
        return kept.select([F.col(f"`{c}`") for c in docs.columns])
    twice_side = F.broadcast(twice) if repeated <= small else twice
    first = Window.partitionBy("doc_id").orderBy(F.col("text"), *[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")])
    place = f"place_{uuid.uuid4().hex}"  # no column of the caller's
    once = kept.join(twice_side, "doc_id", "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select([F.col(f"`{c}`") for c in docs.columns])
    return kept.join(twice_side, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns]).unionByName(once)
