"""Operator 10, document fingerprints: Merkle trees over paragraphs and sections.

A text is cut at line feeds into paragraphs. A paragraph's node is the 128-bit BLAKE2b of its text; a section's node is that of
its paragraphs' hashes in order (a section ends after a paragraph whose hash is divisible by ``SECTION``, so an edit moves no
section but its own), and the root is that of the sections' hashes. Nothing of the text is left out, so equal roots mean equal
texts; where two trees differ, following the differing branches locates the edit. Below a paragraph lie leaves, short runs
of words: a run ends after a word whose hash is divisible by ``LEAF``, after ``LONGEST`` words, or with its paragraph. Leaves are
24-bit tags, which measure and locate an edit inside a paragraph; equality never rests on them.

A fingerprint is the root (32 hex digits), the sections, the paragraphs and the leaves, each in base64 and behind a colon. A
section is 8 bytes of its hash and 4 of its number of paragraphs, a paragraph 8 bytes of its hash and 4 of its number of leaves, a
leaf 3 bytes. Likeness of two fingerprints is 1 for equal roots, else twice the leaves that both have over the leaves of both;
sections that both have are shared whole and not looked into, then paragraphs of the others, and only then leaves.

Defined results: null texts are empty; the empty text has one empty leaf; ``next`` follows ascending ids, null ids first
and equal ids by text; after the last comes the first; an only row is its own next; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHE_WORDS, chunks, mix
from tessera.runtime import ship_package

#: A leaf ends after one word in LEAF and LONGEST words at most; a section ends after one paragraph in SECTION.
LEAF, LONGEST, SECTION = 4, 16, 4
LINE = xxhash.xxh64_intdigest(b"\n", seed=9)


class Hashes(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        h = self[word] = LINE if word == "\n" else xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=5)
        return h


#: A section or paragraph in a fingerprint, and the size of a hash.
ENTRY, DIGEST = np.dtype([("h", ">u8"), ("n", ">u4")]), 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


class Trees:
    """Trees of a list of texts. Level arrays: hashes, sizes, and the number of the text."""

    def __init__(self, texts: list[str], memory: Hashes) -> None:
        if len(memory) > CACHE_WORDS:
            memory.clear()
        parts = [t.replace("\n", " \n ").split(" ") for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        look = memory.__getitem__
        h = np.fromiter((look(w) for own in parts for w in own), np.uint64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        line = (h == np.uint64(LINE)) | last
        leaf_end = line | (mix(h) % np.uint64(LEAF) == 0)
        start = np.flatnonzero(np.append(True, leaf_end[:-1]))
        run = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
        leaf_end |= run % LONGEST == LONGEST - 1
        self.texts = len(texts)
        self.leaf, at = combine(h, leaf_end, 1)
        self.leaf_doc = doc[at]
        paragraph_end = line[np.append(at[1:], len(h)) - 1]

        own = [digest(p.encode("utf-8", "surrogatepass")) for t in texts for p in t.split("\n")]
        raw = b"".join(own)
        heads = np.frombuffer(raw, ">u8").reshape(-1, 2)
        paragraph_doc = self.leaf_doc[np.flatnonzero(np.append(True, paragraph_end[:-1]))] if len(own) else np.zeros(0, np.int64)
        self.paragraph = np.zeros(len(own), ENTRY)
        self.paragraph["h"], self.paragraph["n"] = heads[:, 0], np.diff(np.append(-1, np.flatnonzero(paragraph_end)))
        end = np.flatnonzero(np.append(paragraph_doc[1:] != paragraph_doc[:-1], True) | (heads[:, 1] % SECTION == 0)) if len(own) else np.zeros(0, np.int64)
        begin = np.append(0, end[:-1] + 1)
        sections = [digest(raw[DIGEST * a : DIGEST * (b + 1)]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)] if len(end) else []
        self.section = np.zeros(len(sections), ENTRY)
        self.section_raw = b"".join(sections)
        self.section["h"], self.section["n"] = np.frombuffer(self.section_raw, ">u8").reshape(-1, 2)[:, 0], end - begin + 1 if len(end) else 0
        self.paragraph_doc, self.section_doc = paragraph_doc, paragraph_doc[end]

    def fingerprints(self) -> list[str]:
        tags = (self.leaf & np.uint64(0xFFFFFF)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
        sections, paragraphs = self.section.tobytes(), self.paragraph.tobytes()
        ends = [np.searchsorted(x, np.arange(self.texts + 1)).tolist() for x in (self.section_doc, self.paragraph_doc, self.leaf_doc)]
        out = []
        for a, b, c, d, e, f in zip(*(x[k : len(x) - 1 + k] for x in ends for k in (0, 1)), strict=True):
            parts = sections[12 * a : 12 * b], paragraphs[12 * c : 12 * d], tags[3 * e : 3 * f]
            out.append(":".join([digest(self.section_raw[DIGEST * a : DIGEST * b]).hex(), *(base64.b64encode(x).decode() for x in parts)]))
        return out


def combine(h: np.ndarray, end: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs that end where ``end`` is set, and where they start. Order and length of a run count."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, end[:-1]))
    size = np.diff(np.append(start, len(h)))
    place = (np.arange(len(h)) - np.repeat(start, size)).astype(np.uint64)
    return mix(np.add.reduceat(mix(h + mix(place + np.uint64(level << 40))), start) + size.astype(np.uint64) * np.uint64(level)), start


class Print:
    """A fingerprint taken apart."""

    __slots__ = ("root", "section", "paragraph", "leaf", "first_paragraph", "first_leaf")

    def __init__(self, text: str) -> None:
        self.root, *parts = text.split(":")
        section, paragraph, leaf = map(base64.b64decode, parts)
        self.section, self.paragraph = (np.frombuffer(x, ENTRY) for x in (section, paragraph))
        raw = np.frombuffer(leaf, np.uint8).reshape(-1, 3).astype(np.int64)
        self.leaf = raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]
        self.first_paragraph = np.append(0, np.cumsum(self.section["n"], dtype=np.int64))
        self.first_leaf = np.append(0, np.cumsum(self.paragraph["n"], dtype=np.int64))


def without_shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``a`` and of ``b`` whose hashes the other one lacks; of repeated hashes the first ones are shared."""
    both = set(a.tolist()) & set(b.tolist())
    if not both:
        return np.arange(len(a)), np.arange(len(b))
    left = {x: 1 for x in both}
    if len(a) != len(set(a.tolist())) and len(b) != len(set(b.tolist())):
        times = Counter(a.tolist()) & Counter(b.tolist())
        left = {x: times[x] for x in both}

    def rest(own: np.ndarray) -> np.ndarray:
        free, out = dict(left), []
        for k, x in enumerate(own.tolist()):
            if free.get(x):
                free[x] -= 1
            else:
                out.append(k)
        return np.array(out, np.int64)

    return rest(a), rest(b)


def spans(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places below the nodes ``at``, whose children begin at ``first``."""
    size = first[at + 1] - first[at]
    return np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def branches(a: Print, b: Print) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of ``a`` and of ``b`` below differing branches: first sections, then paragraphs of those, are compared."""
    x, y = without_shared(a.section["h"], b.section["h"])
    p, q = spans(a.first_paragraph, x), spans(b.first_paragraph, y)
    i, j = without_shared(a.paragraph["h"][p], b.paragraph["h"][q])
    return spans(a.first_leaf, p[i]), spans(b.first_leaf, q[j])


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, 0 to 1."""
    out = np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[k] = 1.0
            continue
        p, q = Print(x), Print(y)
        i, j = branches(p, q)
        _, number = np.unique(np.concatenate([p.leaf[i], q.leaf[j]]), return_inverse=True)
        top = int(number.max(initial=-1)) + 1
        shared = len(p.leaf) - len(i) + np.minimum(np.bincount(number[: len(i)], minlength=top), np.bincount(number[len(i) :], minlength=top)).sum()
        out[k] = min(2 * shared / (len(p.leaf) + len(q.leaf)), 1 - 1e-9)
    return out


def differing(a: str, b: str) -> list[int]:
    """The leaves of fingerprint ``a``, by number, that end a differing branch: what of its text ``b`` does not have."""
    if a == b:
        return []
    p, q = Print(a), Print(b)
    i, j = branches(p, q)
    own, _ = without_shared(p.leaf[i], q.leaf[j])
    return i[own].tolist()


def word_spans(text: str, leaves: list[int]) -> list[tuple[int, int]]:
    """(first word, word behind) of leaves of a text (a line feed counts as a word)."""
    ends = np.cumsum([len(x) for x in leaf_words(text)])
    return [(int(ends[i - 1]) if i else 0, int(ends[i])) for i in leaves]


def leaf_words(text: str) -> list[list[str]]:
    """The words of each leaf of a text, one leaf after the other (a line feed counts as a word)."""
    out: list[list[str]] = [[]]
    memory = Hashes()
    words = text.replace("\n", " \n ").split(" ")
    run = 0
    for k, w in enumerate(words):
        out[-1].append(w)
        h = memory[w]
        plain = h == LINE or int(mix(np.array([h], np.uint64))[0]) % LEAF == 0
        run += 1
        if plain or run % LONGEST == 0:
            if k + 1 < len(words):
                out.append([])
            if plain:
                run = 0
    return out


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next."""
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


def neighbours(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows dealt out by ranges of ids, each range followed by the first row of the next range (``after`` = 1).

    Bounds are quantiles of the ids; what is collected is one id a range. Texts are shuffled once.
    """
    spark = docs.sparkSession
    least = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = rows.select("k")
    bounds = sorted({int(x) for x in keys.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []}) if ranges > 1 else []
    if bounds:
        # a binary search over the sorted bounds: the number of bounds at or below the id
        steps = [1 << s for s in range(len(bounds).bit_length() - 1, -1, -1)]
        array = f"array({','.join(f'{b}L' if b > least else '-9223372036854775807L' for b in bounds)})"
        at = F.expr(f"aggregate(array({','.join(map(str, steps))}), 0, (a, s) -> if(a + s <= {len(bounds)} and element_at({array}, least(a + s, {len(bounds)})) <= k, a + s, a))")
    else:
        at = F.lit(0)
    firsts = sorted((r["r"], r["k"]) for r in keys.select(at.alias("r"), "k").groupBy("r").agg(F.min("k").alias("k")).collect())
    # one row a range at most: bounded by the number of ranges, not by the data
    sent = spark.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "first long, target int")
    dealt = rows.withColumn("r", at).join(F.broadcast(sent), rows["k"] == sent["first"], "left")
    both = dealt.select("k", "text", F.explode(F.when(F.col("target").isNull(), F.array(F.struct(F.col("r"), F.lit(0).alias("after")))).otherwise(F.array(F.struct(F.col("r"), F.lit(0).alias("after")), F.struct(F.col("target").alias("r"), F.lit(1).alias("after"))))).alias("to"))
    return both.select("k", "text", "to.r", "to.after").repartitionById(ranges, F.col("r")).sortWithinPartitions("r", "after", "k", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        memory = Hashes()
        held: list[tuple[int, int, int, str]] = []
        over: int | None = None  # the range whose follower has come
        for rest, texts in chunks(batches, limit=2_000_000):
            rows = held
            for r, after, k, t in zip(rest["r"], rest["after"], rest["k"], texts, strict=True):
                if after and r == over:
                    continue  # rows that repeat the first id of the next range
                over = r if after else None
                rows.append((r, after, k, t))
            held = rows[-1:] if rows and not rows[-1][1] else []
            # a row of a range is always followed by another of that range; the one still waiting comes again
            pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][1]]
            if not pairs:
                continue
            own = Trees([r[3] for r in rows], memory).fingerprints()
            changed = [edited(rows[i][3], rows[j][3]) for i, j in pairs]
            theirs = Trees(changed, memory).fingerprints()
            mine, following = [own[i] for i, _ in pairs], [own[j] for _, j in pairs]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([rows[i][2] if rows[i][2] > -(2**63) else None for i, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(rows[i][3]) for i, _ in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                "fingerprint": pa.array(mine, pa.string()),
                "edited_fingerprint": pa.array(theirs, pa.string()),
                "near_edited": pa.array(likeness(mine, theirs), pa.float64()),
                "near_next": pa.array(likeness(mine, following), pa.float64()),
            })

    return neighbours(docs, ranges).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
