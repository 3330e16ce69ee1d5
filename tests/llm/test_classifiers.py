"""Quality, language and toxicity: held-out accuracy, brute force of the scores, edge cases."""

import itertools
import math
import zlib

import numpy as np
import pytest

from tessera.llm import common, language, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"
EDGES = [(None, None, None), (1, "", "en"), (2, "12 34 !!", "fr"), (3, "the the the", None), (3, "the the the", "en"), (4, "x" * 300_000, "en"), (5, "word " * 60_000, "fr"), (6, "the and of that", "en")]


def documents(spark, rows):
    return spark.createDataFrame([(d, t, la, "s", len(t or ""), 0.0, 0) for d, t, la in rows], DOCS)


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def tables(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark, larger):
    docs, labels = tables(spark, larger)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == held(d) and r.predicted == (r.score >= 0.7) for d, r in got.items())
    truth = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if held(r.doc_id)]
    assert np.mean([a == b for a, b in truth]) > 0.9


def test_quality_score_is_the_softmax_of_averaged_vectors():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=(quality.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    scorer = quality.Scorer(model)
    texts = ["a bb bb ccc", "", None, "Zz zz Zz " * 50]
    for text, p in zip(texts, scorer(texts), strict=True):
        ids, share = quality.document_features(text or "")
        z = (share[:, None] * model.table[ids]).sum(axis=0) + model.bias
        assert abs(p - np.exp(z[1]) / np.exp(z).sum()) < 1e-5


def test_quality_repeats_are_one_feature():
    vocabulary = quality.Words()
    n = vocabulary.numbers("new new word".split())
    assert quality.pair_features(n, quality.token_hashes(vocabulary.fresh))[0] == quality.REPEAT


@pytest.mark.parametrize("rows", [EDGES, []])
def test_quality_edges(spark, rows):
    labels = spark.createDataFrame([(3, 1, 0), (6, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(documents(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.quality(documents(spark, rows), labels.limit(0)).collect()
    assert all(r.score == 0.5 for r in none)


def test_language_on_held_out_rows(spark, larger):
    docs, _ = tables(spark, larger)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.language(docs).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.95


def test_language_vectors_by_hand():
    model = language.fit([("abc abd", "x"), ("zzy zyy", "y")])
    table, vectors = language.symbol_table(model.alphabet), language.letter_vectors(len(model.alphabet) + 2)
    sym = [0, *[table[ord(c)] for c in "ab"], 0]
    want = sum(vectors[sym[i]].astype(int) * np.roll(vectors[sym[i + 1]], 1) * np.roll(vectors[sym[i + 2]], 2) for i in range(2))
    assert (language.bundles(["ab"], table, vectors)[0][0] == want).all()


def test_language_rejects_what_was_not_learned(spark, larger):
    docs, _ = tables(spark, larger)
    rng = np.random.default_rng(5)
    foreign = [(1_000_000 + r.doc_id, r.text, None) for r in docs.where("lang = 'de' and length(text) > 300").limit(60).collect()]  # short texts are given the benefit of the doubt
    noise = [(2_000_000 + i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(60)), None) for i in range(40)]
    learned = docs.where("lang != 'de'")
    for languages in ("lang in ('en', 'es', 'fr')", "lang in ('en', 'fr')", "lang = 'en'"):
        own = learned.where(languages).select("doc_id", "text", "lang")
        kept = [r.doc_id for r in language.with_language(own.unionByName(documents(spark, foreign + noise).select("doc_id", "text", "lang"))).collect()]
        assert not [d for d in kept if d >= 2_000_000]
        assert sum(1_000_000 <= d < 2_000_000 for d in kept) <= 6  # of 60: the rule leans towards keeping
        assert sum(d < 1_000_000 for d in kept) >= 0.995 * own.count()


def test_short_and_repetitive_texts_of_a_learned_language_stay(spark, larger):
    docs, _ = tables(spark, larger)
    own = docs.where("lang is not null and text rlike '[A-Za-z]'").select("doc_id", "text", "lang")
    kept = language.with_language(own)
    assert kept.count() >= own.count() - 1
    model = language.fit(language.training_rows(docs, 4000))
    words = [w for r in docs.where("lang = 'en'").limit(40).collect() for w in r.text.split() if w.isalpha()][:300]
    texts = ["This.", "A.", *words, *(" ".join([w] * 40) for w in words[:20])]
    lang, score, known = language.Predictor(model)(texts)
    assert set(lang) <= set(model.languages) and known.mean() > 0.97


def test_every_text_with_a_letter_gets_a_language(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the and of that", "en"), ("les des que une", "fr")] * 8)] + [(100, "q", None), (101, "щ", None), (102, "xqz " * 99, None)]
    got = {r.doc_id: r for r in language.language(documents(spark, rows)).collect()}
    assert {got[d].lang_pred for d in got} == {"en", "fr"} and all(0 <= r.score <= 1 for r in got.values())
    assert not got[102].known and got[0].known


def test_language_letters_share_no_vector():
    rng = np.random.default_rng(6)
    scripts = {"latin": 0x61, "greek": 0x3B1, "cyrillic": 0x430, "georgian": 0x10D0, "han": 0x4E00, "kanji": 0x7000, "hangul": 0xAC00, "gothic": 0x10330}

    def text(first, letters=20):
        return " ".join("".join(chr(first + k) for k in rng.integers(0, letters, 6) ** 2 // letters) for _ in range(60))

    common = [(text(first), name) for name in ("latin", "greek", "cyrillic", "georgian") for first in [scripts[name]] for _ in range(30)]
    common += [(text(0x1200, 80), "ethiopic") for _ in range(200)]
    model = language.fit(common + [(text(scripts[name]), name) for name in ("han", "kanji", "hangul", "gothic") for _ in range(10)])
    predictor = language.Predictor(model)
    for name, first in scripts.items():
        assert predictor([text(first) for _ in range(20)])[0] == [name] * 20
    codes = [c for first in scripts.values() for c in range(first, first + 20)]
    assert len({predictor.vectors[predictor.table[c]].tobytes() for c in codes}) == len(codes)


@pytest.mark.parametrize("rows", [EDGES, []])
def test_language_edges(spark, rows):
    got = language.language(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_toxicity_finds_planted_words(spark, larger):
    docs, labels = tables(spark, larger)
    words = ["idiot", "moron", "scum"]
    clean = [(10_000 + i, "the plan of the day and the way that it is made " * 3, "en") for i in range(120)]
    bad = [(20_000 + i, f"the plan {words[i % 3]} of the {words[(i + 1) % 3]} day and {words[i % 3]} the way", "en") for i in range(60)]
    own = spark.createDataFrame([(d, 1, int(d >= 20_000)) for d, _, _ in clean + bad], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(documents(spark, clean + bad), own).collect()}
    assert all(got[d].toxic == (d >= 20_000) for d in got)
    assert all(0 <= r.severity <= toxicity.GRADES and 0 <= r.grade <= toxicity.GRADES for r in got.values())
    real = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert sum(r.toxic for r in real if r["toxic"] is False) == 0


def test_quality_training_equals_descent_by_hand(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 97)
    monkeypatch.setattr(quality, "DIM", 3)
    monkeypatch.setattr(quality, "EPOCHS", 3)
    rows = [("good solid text here", 1), ("bad bad spam", 0), ("", 1), ("more good text", 1), ("spam spam offer", 0), (None, 0)]
    model = quality.fit(rows, seed=3)
    data = [(*quality.document_features(t), y) for t, y in rows if t]
    rng = np.random.default_rng(3)
    v = rng.uniform(-1 / 3, 1 / 3, (97, 3)).astype(np.float32).astype(float).tolist()
    w, b = [[0.0, 0.0] for _ in range(3)], [0.0, 0.0]
    total, step = 3 * len(data), 0
    for _ in range(3):
        for i in rng.permutation(len(data)):
            ids, share, y = data[i]
            rate, step = quality.RATE * (1 - step / total), step + 1
            mean = [sum(float(s) * v[f][k] for f, s in zip(ids, share)) for k in range(3)]
            z = [sum(mean[k] * w[k][c] for k in range(3)) + b[c] for c in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            error = [x / sum(e) - (c == y) for c, x in enumerate(e)]  # of the softmax's cross-entropy by its logits
            back = [sum(w[k][c] * error[c] for c in (0, 1)) for k in range(3)]
            for k in range(3):
                for c in (0, 1):
                    w[k][c] -= rate * mean[k] * error[c]
            for c in (0, 1):
                b[c] -= 0.1 * rate * error[c]
            for f, s in zip(ids, share):
                for k in range(3):
                    v[f][k] -= rate * 20 * float(s) * back[k]
    want = [[sum(v[f][k] * w[k][c] for k in range(3)) for c in (0, 1)] for f in range(97)]
    assert np.allclose(model.table, want, atol=1e-4) and np.allclose(model.bias, b, atol=1e-4)


def test_toxicity_likelihood_and_gradient_equal_brute_force():
    rng = np.random.default_rng(3)
    row, col, val, grade = np.repeat(np.arange(9), 2), rng.integers(0, 4, 18), rng.random(18), rng.integers(0, 4, 9)
    theta = rng.normal(0, 0.5, 4 + toxicity.GRADES)

    def brute(theta):
        b = [theta[4]]
        for gap in theta[5:]:
            b.append(b[-1] + math.log(1 + math.exp(gap)))
        total = 0.0
        for i in range(9):
            s = sum(theta[c] * v for r, c, v in zip(row, col, val) if r == i)
            above = [1.0, *(1 / (1 + math.exp(x - s)) for x in b), 0.0]
            total -= math.log(above[grade[i]] - above[grade[i] + 1])
        return total / 9 + 0.5e-5 * sum(theta[:4] ** 2)

    value, slope = toxicity.loss(theta, row, col, val, grade)
    assert abs(value - brute(theta)) < 1e-9
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        assert abs((brute(theta + step) - brute(theta - step)) / 2e-5 - slope[k]) < 1e-6


def test_toxicity_score_equals_brute_force():
    model = toxicity.Model({"bad": 2.0, "badl-": 1.0, toxicity.DENSITY: 0.5}, np.array([1.0, 2.0, 4.0]))
    texts = ["bad badly fine", "Bad, BAD", "fine", "", None, "badness " * 5 + "x " * 30]

    def brute(text):
        words, hits = (text or "").split(), {}
        for token in words:
            own = [f for f in toxicity.token_features(token) if f in model.weights]
            for f in own:
                hits[f] = hits.get(f, 0) + 1 / len(own)
        z = sum(model.weights[f] * math.log2(1 + n) for f, n in hits.items())
        z += model.weights[toxicity.DENSITY] * math.log2(1 + toxicity.PER * sum(hits.values()) / len(words)) if hits else 0
        return [1 / (1 + math.exp(b - z)) for b in model.bias]

    assert np.allclose(toxicity.Scorer(model)(texts), [brute(t) for t in texts])


def test_toxicity_test_of_features_equals_counting():
    for toxic, total in ((3, 8), (5, 9)):
        for k in range(1, total + 1):
            draws = [sum(i < toxic for i in c) for c in itertools.combinations(range(total), k)]
            for a in range(k + 1):
                want = sum(d >= a for d in draws) / len(draws) if a * total > k * toxic else 1.0
                assert abs(toxicity.tail(a, k, toxic, total) - want) < 1e-9


def test_toxicity_catches_held_out_labels(spark):
    """Of the labelled toxic texts of these tables, one in twenty holds none of the words that the others share."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.toxic for r in found if truth[r.doc_id] == 1) >= 0.9 * sum(truth[r.doc_id] == 1 for r in found)
    assert sum(r.toxic for r in found if truth[r.doc_id] == 0) <= 0.01 * sum(truth[r.doc_id] == 0 for r in found)


def test_few_toxic_labels_leave_every_text_at_the_prior():
    with pytest.warns(UserWarning, match="prior"):
        model = toxicity.fit([("an insult", 1), ("another insult", 1)] + [(f"fine text {i}", 0) for i in range(30)])
    p = toxicity.Scorer(model)(["an insult", "fine"])
    assert np.allclose(p[0], p[1]) and p[0, 0] < toxicity.THRESHOLD


def test_one_giant_text_does_not_empty_the_sample(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i == 3 else 10)) for i in range(20)], "doc_id long, text string")
    kept = {r.doc_id for r in common.within(docs, 500).collect()}
    assert kept == set(range(20)) - {3}


def test_toxicity_thresholds_are_ordered_and_shared():
    rows = [("fine words here", 0)] * 50 + [("bad", 1)] * 12 + [("bad bad bad", 1)] * 12 + [("bad " * 20, 1)] * 12
    model = toxicity.fit(rows)
    assert (np.diff(model.bias) > 0).all()
    p = toxicity.Scorer(model)(["fine", "bad", "bad " * 20, None, ""])
    assert (np.diff(p, axis=1) <= 0).all() and p[2].sum() > p[1].sum() > p[0].sum() == p[3].sum() == p[4].sum()


@pytest.mark.parametrize("rows", [EDGES, []])
def test_toxicity_edges(spark, rows):
    labels = spark.createDataFrame([(3, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(documents(spark, rows), labels).collect()
    assert len(got) == len(rows) and not any(r.toxic for r in got)
    assert toxicity.without_toxic(documents(spark, rows), labels).columns == documents(spark, rows).columns
    assert toxicity.without_toxic(documents(spark, rows), labels).count() == len(rows)


def test_training_samples_are_bounded(spark):
    docs = documents(spark, [(i, "word " * 100, "en") for i in range(40)])
    found = docs.select("doc_id", "text")
    assert common.within(found, 10**6).count() == 40
    assert 0 < common.within(found, 5000).count() <= 10 and common.within(found, 10).count() == 0
