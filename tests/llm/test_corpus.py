"""Near-duplicates, stupid backoff and the pipeline against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import lm, neardup
from tessera.llm.components import components

RNG = random.Random(11)


def shingle_set(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    return frozenset(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows, percent):
    """doc_id, n_shingles, component, kept by comparing all pairs."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        (a, x), (b, y) = sets[i], sets[j]
        if x and y and a is not None and b is not None and (a == b or 100 * len(x & y) >= percent * len(x | y)):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    out = []
    for i, (d, x) in enumerate(sets):
        c = least.get(root(i)) if x and d is not None else d
        out.append((d, len(x), c, True if d is None else c == d))
    return sorted(out, key=repr)


def near_rows():
    words = [f"w{i}" for i in range(400)]
    base = [RNG.choice(words) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        own = base.copy()
        for _ in range(RNG.randint(0, 9)):
            own[RNG.randrange(len(own))] = RNG.choice(words)
        rows.append((i, RNG.choice([" ", "\n", "\x0b "]).join(own).upper() if i % 2 else " ".join(own)))
    passage = " ".join(base[:30])
    rows += [(100 + i, passage + " " + " ".join(RNG.choice(words) for _ in range(60))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "One TWO"), (205, "É x"), (206, "é x"), (None, "one two"), (None, None)]
    rows += [(207, "a\xa0b c d e f"), (208, "a b c d e f"), (300, "x " * 40_000), (301, "X " * 39_000), (302, "same text again and again"), (302, "same text again and again")]
    return rows


@pytest.mark.parametrize("percent", [80, 85, 95])
@pytest.mark.parametrize(("small", "block", "members"), [(10**6, 10**6, 10**6), (0, 700, 128), (10, 10**6, 5)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, percent, small, block, members):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", members)
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, component_id int, kept string").repartition(3)
    got = neardup.near_duplicates(docs, percent, small, block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute(rows, percent)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, "one text of its own here"), (5, "another text with other words"), (3, "another text with other words"), (9, "a third text quite alone")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, `a.b` int")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    assert sorted(r.doc_id for r in neardup.representatives(docs).collect()) == [3, 9]


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0 and neardup.representatives(empty).count() == 0


def test_sketches_bound_the_miss():
    for t in (0.8, 0.85, 0.95):
        m = neardup.sketches_needed(t)
        assert 2 * (1 - t**neardup.R) ** m <= neardup.MISS


def test_representatives_keep_all_columns_and_one_of_each(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = neardup.representatives(docs, 80)
    assert kept.columns == docs.columns
    want = sorted({d for d, _, c, k in brute(rows, 80) if k and d is not None}) + [None, None]
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted(want, key=repr)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    links = spark.createDataFrame(chain + star + [(7, 7), (None, 3), (39, 2)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}
    assert components(links.limit(0)).count() == 0


def brute_scores(rows, order):
    words = [(t or "").lower().split() for _, t in rows]
    counts = [Counter(g for w in words for g in zip(*[w[i:] for i in range(n)])) for n in range(1, order + 1)]
    total = sum(map(len, words))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        own = [Counter(zip(*[w[i:] for i in range(n)])) for n in range(1, order + 1)]

        def value(i, n):
            if n == 1:
                c = counts[0][(w[i],)] - own[0][(w[i],)]
                return (c or 0.5) / max(1, total - len(w))
            g = tuple(w[i - n + 1 : i + 1])
            c, k = counts[n - 1][g] - own[n - 1][g], counts[n - 2][g[:-1]] - own[n - 2][g[:-1]]
            return min(c / k, 1) if c and k else lm.ALPHA * value(i, n - 1)

        s = sum(math.log(value(i, min(order, i + 1))) for i in range(len(w)))
        out.append((d, len(w), round(s, 6), round(s / len(w), 6) if w else None))
    return sorted(out, key=repr)


def test_registered_scores_are_of_trigrams(spark, tmp_path):
    rows = [(i, " ".join(RNG.choice("a b c d e".split()) for _ in range(30))) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op4_lm_scoring"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_words, round(r.score_sum, 6), round(r.score_mean, 6)) for r in got) == sorted(brute_scores(rows, 3))


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize(("size", "cell"), [(50, 100), (300, 2), (10**7, 10**7)])
def test_backoff_equals_brute_force(spark, monkeypatch, order, size, cell):
    monkeypatch.setattr(lm, "BLOCK_CHARS", size)
    monkeypatch.setattr(lm, "CELL", cell)
    rows = [(i, " ".join(RNG.choice("the cat sat on a mat Dog ran".split()) for _ in range(RNG.randint(0, 25)))) for i in range(60)] + [(None, None), (70, ""), (71, "unseen"), (71, "unseen"), (72, "the cat " * 5000)]
    docs = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, block int").repartition(3)
    got = lm.scores(docs, order).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.score_sum, 6), None if r.score_mean is None else round(r.score_mean, 6)) for r in got), key=repr) == brute_scores(rows, order)


def test_backoff_of_nothing(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planes_round_trip():
    import numpy as np

    a = np.array([0, 1, 2**63, 7], np.uint64)
    assert (lm.unpacked(lm.packed(a), np.uint64, 4) == a).all()
    h = np.sort(np.random.default_rng(3).integers(0, 2**64, 1000, dtype=np.uint64))
    for cells in (1, 7, 4095, 4096, 5000):
        code = lm.codes(h, cells)
        assert (np.diff(np.sort(code)) > 0).all()
        spans = list(lm.cell_ends(np.sort(code), cells))
        assert [a for _, a, _ in spans] + [1000] == [0] + [b for _, _, b in spans] and sorted({c for c, _, _ in spans}) == [c for c, _, _ in spans]
        assert max(c for c, _, _ in spans) < cells


@pytest.fixture
def larger():
    return "/root/testdata/sf0.01"


def noise(n):
    return " ".join("".join(RNG.choice("bcdfghjklmnpqrstvwxz") for _ in range(RNG.randint(3, 9))) for _ in range(n))


def test_stages_work_on_what_came_through(spark, larger):
    """Each stage on its own input: planted rows that must go, rows that must stay, and what the stage says by hand."""
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    plain = [r for r in docs.where("length(text) > 400").orderBy("doc_id").collect()]
    insulted = [(2 * 10**6 + i, r.text + " idiot moron scum loser" * 8, r.lang, "s", 1) for i, r in enumerate(plain[:5])]
    unknown = [(10**6, "1234 5678 !!", "en", "s", 12), (10**6 + 1, None, None, None, None), (10**6 + 2, noise(80), "en", "s", 1), (10**6 + 3, "мир и труд для всех людей доброй воли " * 9, None, "s", 1)]
    copies = [(3 * 10**6 + i, r.text, r.lang, "s", 1) for i, r in enumerate(plain[-5:])]
    now = docs.unionByName(spark.createDataFrame([*insulted, *unknown, *copies], docs.schema))
    labelled = {r.doc_id for r in spark.read.parquet(f"{larger}/labels.parquet").where("toxic = 0").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, larger)
        rows = out.collect()
        before = {r.doc_id: r.text for r in now.collect()}
        ids = {r.doc_id for r in rows}
        gone = before.keys() - ids
        assert ids <= before.keys()
        if name == "toxicity":
            assert {d for d, *_ in insulted} <= gone and not gone & labelled and {d for d, *_ in unknown} <= ids
        if name == "language_id":
            assert {d for d, *_ in unknown} <= gone
            # what goes besides has nearly no letters, or letters in no usual order; plain prose of the four languages stays
            prose = {d for d, t in before.items() if t and len(t) > 400 and sum(c.isalpha() for c in t) > 0.6 * len(t)} - {d for d, *_ in unknown}
            assert len(prose & gone) <= 0.01 * len(prose)
        if name == "near_dedup":
            assert ids == {d for d, _, _, k in brute([(r.doc_id, r.text) for r in now.collect()], 80) if k}
            assert {d for d, *_ in copies} <= gone
        if name == "packing":
            assert ids == before.keys()
            full = {}
            for r in rows:
                full.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert all(sum(n for _, n in parts) <= 2048 and min(parts)[0] == 0 for parts in full.values())
        else:
            assert out.columns == docs.columns
            now = spark.createDataFrame(rows, docs.schema)


def test_pipeline_runs_and_is_registered(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "packing"]
    out = entry.queries()["pipeline"](spark, small)
    assert out.columns[:2] == ["doc_id", "piece"] and out.count() > 0
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", q)[0] for q in entry.queries() if q.startswith("op")}
