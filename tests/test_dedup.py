"""Hand-made snapshots with known duplicates, and properties of the candidate filters."""

import itertools
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions.canonical import canonical
from tessera.functions.similarity import best_from_overlap, jaro_winkler, least_overlap
from tessera.functions.text import normalize_url, plain_name, token_key
from tessera.operators import metadata, names, snapshot, uri
from tessera.plans import more_queries, registry, report_queries  # noqa: F401
from tessera.runtime import scratch_dir

SCHEMA = "chain string, contract string, token_id string, name_norm string, token_uri string, image_uri string, body string, row_order long"


def nfts(spark, rows):
    full = [(c, k, str(i), n, t, m, b, i) for i, (c, k, n, t, m, b) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def scopes(df):
    return {(r.scope, r.chain, r.peer): (r.contracts, r.nfts) for r in df.collect()}


def test_uri_shared_in_a_chain_and_across(spark):
    own = nfts(spark, [("ethereum", "a", "x", "u", "", ""), ("ethereum", "b", "y", "u", "", ""), ("base", "c", "z", "u", "", ""), ("ethereum", "d", "w", "v", "", "")])
    got = scopes(uri.token_uri_scopes(own))
    assert got == {("intra", "ethereum", "ethereum"): (2, 2), ("cross", "ethereum", ""): (2, 2), ("cross", "base", ""): (1, 1), ("matrix", "ethereum", "base"): (2, 2), ("matrix", "base", "ethereum"): (1, 1)}


def test_two_tokens_of_one_contract_are_no_duplicates(spark):
    assert not scopes(uri.token_uri_scopes(nfts(spark, [("base", "a", "", "u", "", ""), ("base", "a", "", "u", "", "")])))


def test_image_is_supplementary_per_scope(spark):
    rows = [("ethereum", "a", "", "t", "i", ""), ("ethereum", "b", "", "t", "i", ""), ("base", "c", "", "o", "i", "")]
    got = scopes(uri.image_uri_scopes(nfts(spark, rows)))
    assert ("intra", "ethereum", "ethereum") not in got
    assert got["matrix", "ethereum", "base"] == (2, 2) and got["cross", "base", ""] == (1, 1)


def test_empty_and_null_uris_and_tables(spark):
    own = nfts(spark, [("base", "a", None, None, None, None), ("base", "b", "", "", "", "")])
    assert uri.token_uri_scopes(own).count() == 0 and uri.image_uri_scopes(own).count() == 0
    assert names.members(own).count() == 0
    assert uri.token_uri_scopes(own.limit(0)).count() == 0


def test_ratio_over_zero_is_null(spark):
    s = spark.createDataFrame([("intra", "base", "base", 1, 1)], "scope string, chain string, peer string, contracts long, nfts long")
    t = spark.createDataFrame([("base", 0, 0)], "chain string, contracts long, nfts long")
    assert uri.with_ratios(s, t, F.lit("x")).first().nft_ratio is None


def test_overlap_bound_loses_no_pair():
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)]
    for t in (0.5, 0.8, 0.95, 1.0):
        for a, b in itertools.combinations(words, 2):
            if jaro_winkler(a, b) >= t:
                shared = sum(min(a.count(c), b.count(c)) for c in "ab")
                assert shared >= least_overlap(len(a), len(b), t)
                assert best_from_overlap(len(a), len(b), shared) >= jaro_winkler(a, b) - 1e-12


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.65, 0.75, 0.85, 0.9, 0.95])
def test_similar_names_equal_brute_force(spark, threshold):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcd ") for _ in range(rng.randint(3, 9))).strip() or "a" for _ in range(120)}
    got = {(r.left, r.right) for r in names.similar_names(spark.createDataFrame([(w,) for w in words], "name string"), threshold).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(words), 2) if jaro_winkler(a, b) >= threshold}


def brute_bm25(a, b):
    import math
    import re
    from collections import Counter

    x, y = (Counter(re.findall(r"\w+", t.lower())) for t in (a, b))
    mean = (sum(x.values()) + sum(y.values())) / 2

    def vector(own, other):
        n = sum(own.values())
        return {t: (math.log(1.2) if t in other else math.log(2)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / max(mean, 1))) for t, f in own.items()}

    v, w = vector(x, y), vector(y, x)
    return sum(v[t] * w[t] for t in v.keys() & w.keys()) / math.sqrt(sum(z * z for z in v.values()) * sum(z * z for z in w.values()))


def random_texts(n=60):
    rng = random.Random(9)
    vocabulary = "red blue green cat dog ape punk gold rare common one two".split()
    return {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 9))) for i in range(n)}


def brute_score(a, b):
    return 1.0 if a == b else brute_bm25(a, b)


@pytest.mark.parametrize("probed", [False, True])
def test_long_names_of_few_letters_are_not_joined_by_letter(spark, probed):
    rng = random.Random(5)
    words = {"".join(rng.choice("aeinst ") for _ in range(rng.choice([23, 24, 24]))) for _ in range(150)}
    for w in sorted(words)[:60]:
        k = rng.randrange(len(w) - 1)
        words |= {w[:k] + rng.choice("xq") + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w * 12}
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "name string")
    probes = sorted(words)[::7]
    found = names.similar_names(frame, 0.93, spark.createDataFrame([(w,) for w in probes], "name string") if probed else None)
    got = [(r.left, r.right, r.score) for r in found.collect()]
    pairs = ((a, b) for a in probes for b in words if a != b) if probed else itertools.combinations(sorted(words), 2)
    want = [(a, b, jaro_winkler(a, b)) for a, b in pairs if jaro_winkler(a, b) >= 0.93]
    assert len(want) > 15 and sorted(got) == sorted(want)
    assert "Join" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("threshold", [-1.0, 0.0, 0.3, 0.6, 0.8])
def test_metadata_matches_lose_no_link(spark, threshold):
    texts = random_texts() | {100: "red cat", 101: "red cat", 102: "cat red", 103: "red cat"}
    docs = spark.createDataFrame([*texts.items(), (200, None)], "doc long, text string")
    pairs, member = metadata.matches(docs, threshold)
    got = {(r.left, r.right): r.score for r in pairs.collect()}
    rep = {r.doc: r.rep for r in member.collect()}
    first = {t: min(i for i in texts if texts[i] == t) for t in texts.values()}
    assert rep == {i: first[t] for i, t in texts.items()}
    want = {(a, b): brute_bm25(texts[a], texts[b]) for a, b in itertools.combinations(sorted(first.values()), 2) if brute_bm25(texts[a], texts[b]) >= threshold - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_probes_find_every_match_of_copies(spark):
    texts = random_texts() | {100: "red cat gold", 101: "red cat gold", 102: "cat red gold ape", 103: "cat red gold ape"}
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    probes = spark.createDataFrame([(101,), (103,), (7,)], "doc long")
    pairs, member = metadata.matches(docs, 0.35, probes)
    got = {(r.probe, r.other) for r in metadata.expanded(pairs, member, probes).collect()}
    assert got == {(p, o) for p in (101, 103, 7) for o in texts if o != p and brute_score(texts[p], texts[o]) >= 0.35}
    assert {(101, 102), (103, 100), (101, 100)} <= got


def written(spark, label):
    """Bytes of the scratch tables whose names begin so."""
    return sum(p.stat().st_size for p in Path(scratch_dir(spark)).glob(f"{label}*/*.parquet"))


@pytest.mark.parametrize("probed", [False, True])
def test_matches_of_long_texts_write_no_rows_of_terms(spark, probed):
    rng = random.Random(31)
    texts = {}
    for i in range(160):
        words = [f"w{rng.randint(0, 60000)}" for _ in range(rng.choice([6, 40, 300, 1500, 2500]))]
        texts[2 * i] = " ".join(words)
        for _ in range(rng.randint(0, len(words) // 12)):
            words[rng.randrange(len(words))] = rng.choice(words)
        texts[2 * i + 1] = " ".join([*words, "end"] if i < 40 else (f"v{rng.randint(0, 60000)}" for _ in words))
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    probes = spark.createDataFrame([(i,) for i in range(0, 320, 5)], "doc long") if probed else None
    before, rows = written(spark, "metadata"), written(spark, "metadata-terms")
    pairs, _ = metadata.matches(docs, 0.6, probes)
    got = {(r.left, r.right): r.score for r in pairs.collect()}
    assert written(spark, "metadata-terms") == rows and written(spark, "metadata") - before < sum(map(len, texts.values()))
    want = {(i, i + 1): brute_bm25(texts[i], texts[i + 1]) for i in range(0, 320, 2)}
    want = {k: v for k, v in want.items() if v >= 0.6 and (not probed or k[0] % 5 == 0 or k[1] % 5 == 0)}
    assert len(want) > 5 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_probes_at_low_thresholds_write_no_rows_of_terms(spark):
    texts = {i: s for i, s in enumerate(sorted(set(random_texts(90).values())))}
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    before = written(spark, "metadata-terms")
    pairs, _ = metadata.matches(docs, 0.2, spark.createDataFrame([(i,) for i in range(0, 60, 4)], "doc long"))
    got = {(r.left, r.right): r.score for r in pairs.collect()}
    want = {(a, b): brute_bm25(texts[a], texts[b]) for a, b in itertools.combinations(texts, 2) if any(x < 60 and x % 4 == 0 for x in (a, b))}
    want = {k: v for k, v in want.items() if v >= 0.2 - 1e-12}
    assert written(spark, "metadata-terms") == before
    assert len(want) > 40 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_member_pairs_and_hits_equal_brute_force(spark):
    rng = random.Random(12)
    texts = list(random_texts(14).values())
    rows = [(rng.choice(["base", "ethereum", "solana"]), f"c{rng.randint(0, 5)}", str(rng.randint(1, 3)), "n", "t", "i", rng.choice(texts), i) for i in range(60)]
    own = spark.createDataFrame(rows, SCHEMA)
    anchor = {}
    for chain, contract, token, _, _, _, body, row in rows:
        member = f"{chain}/{contract}" + (f"/{token}" if chain == "solana" else "")
        anchor.setdefault(member, {})[int(token)] = max(anchor.get(member, {}).get(int(token), (-1, "")), (row, body))
    chain_of = {m: m.split("/")[0] for m in anchor}
    contract_of = {m: "/".join(m.split("/")[:2]) for m in anchor}
    want = set()
    for a, b in itertools.combinations(sorted(anchor), 2):
        if contract_of[a] == contract_of[b]:
            continue
        shared = anchor[a].keys() & anchor[b].keys() if "solana" not in (chain_of[a], chain_of[b]) else set()
        x, y = (anchor[m][max(shared) if shared else max(anchor[m])][1] for m in (a, b))
        if brute_score(x, y) >= 0.6:
            want.add((a, b))
    anchors = metadata.with_documents(metadata.anchors(own))
    links = metadata.document_links(anchors, 0.6)
    assert {(r.left, r.right) for r in metadata.member_pairs(anchors, links).collect()} == want
    some = sorted(anchor)[::3]
    seeded = metadata.member_pairs(anchors, links, spark.createDataFrame([(m,) for m in some], "member string"))
    assert {(r.left, r.right) for r in seeded.collect()} == {(a, b) for a, b in want if a in some} | {(b, a) for a, b in want if b in some}
    hits = {(r.member, r.peer) for r in metadata.metadata_hits(own, 0.6).collect()}
    assert hits == {(a, chain_of[b]) for a, b in want} | {(b, chain_of[a]) for a, b in want}


def test_canonical_json():
    assert canonical('{"B": 1.50, "a": "  Ａ  b "}') == '{"a":"a b","b":1.5}'
    assert canonical('{"a": 1, "a": 2}') is None and canonical('{"a": 1, "A": 2}') is None
    assert canonical("7") is None and canonical(None) is None and canonical('{"x": NaN}') is None and canonical("[" * 100_000) is None
    assert canonical('{"attributes": [{"trait_type": "z", "value": 1}, {"trait_type": "a", "value": 2}]}').index('"a"') < canonical('{"attributes": [{"trait_type": "z", "value": 1}, {"trait_type": "a", "value": 2}]}').index('"z"')
    assert canonical('{"n": 1e3, "m": 100.0, "k": -0.00120}') == '{"k":-0.0012,"m":100,"n":1000}'


def test_names_and_urls(spark):
    assert [plain_name(x) for x in ("Azuki #123", "Cool Cat (3)", "A  B - 7 #0xff", "plain", "Ａzuki", "#5")] == ["azuki", "cool cat", "a b", "plain", "azuki", ""]
    rows = [(" HTTPS://X.com/A// ",), ("https://gw.io/ipfs/QmA/1?x#y",), ("ipfs://ipfs/QmB/",), ("DATA:x",), ("null",), ("",), (None,), ("ipfs:///",)]
    got = [r.u for r in spark.createDataFrame(rows, "u string").select(normalize_url(F.col("u")).alias("u")).collect()]
    assert got == ["https://x.com/a", "ipfs:QmA/1", "ipfs:QmB", None, None, None, None, None]


def test_token_order_beyond_64_bits(spark):
    ids = ["10", "9", "007", "340282366920938463463374607431768211456", "abc", "0"]
    got = [r.t for r in spark.createDataFrame([(i,) for i in ids], "t string").orderBy(token_key(F.col("t"))).collect()]
    assert got == ["0", "007", "9", "10", "340282366920938463463374607431768211456", "abc"]


def test_aligned_on_the_largest_shared_token(spark):
    rows = [("a", "ethereum", 3, "a3"), ("a", "ethereum", 2, "a2"), ("a", "ethereum", 1, "a1"), ("b", "base", 4, "b4"), ("b", "base", 3, "b3"), ("b", "base", 1, "b1"), ("c", "base", 9, "c9"), ("s", "solana", 3, "s3"), ("s", "solana", 5, "s5")]
    anchors = spark.createDataFrame(rows, "contract string, chain string, token_key int, doc string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "s")], "left string, right string")
    got = {(r.left, r.right): (r.left_doc, r.right_doc) for r in metadata.aligned_documents(anchors, pairs).collect()}
    assert got == {("a", "b"): ("a3", "b3"), ("a", "c"): ("a3", "c9"), ("a", "s"): ("a3", "s5")}


def test_threshold_clusters(spark):
    def clusters(pairs):
        return {r.name: r.cluster for r in snapshot.threshold_clusters(spark.createDataFrame(pairs, "left string, right string")).collect()}

    assert clusters([("a", "b"), ("d", "e")]) == {"a": "a", "b": "a", "d": "d", "e": "d"}
    assert clusters([("a", "b"), ("b", "c"), ("d", "e")])["c"] == "a"
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)]
    assert set(clusters(chain).values()) == {"n00"}


def test_snapshot_rules(spark):
    own = nfts(spark, [(" Base ", "a", " n ", None, "", ""), (None, "a", "", "", "", ""), ("base", "", "", "", "", "")])
    rows = snapshot.normalised(own).collect()
    assert [(r.chain, r.name_norm, r.token_uri) for r in rows] == [("base", "n", "")]
    dup = spark.createDataFrame([("base", "a", None, "x", 1), ("base", "a", "t", "", 2), ("base", "a", "u", "y", 3)], "chain string, contract string, p string, q string, o int")
    assert snapshot.first_wins(dup, ["chain", "contract"], ["p", "q"], "o").first()[2:] == ("t", "x")


@pytest.mark.parametrize("name", ["d17_candidate_registry", "d8_pair_choice", "j10_aligned_documents", "d12_metadata_scopes", "d18_duplicate_scale"])
def test_anchors_of_queries_hold_no_texts(spark, small, name):
    def tables():
        return set(Path(scratch_dir(spark)).glob("metadata-anchors*"))

    before = tables()
    assert registry.QUERIES[name](spark, small).columns
    made = tables() - before
    assert made and all("text" not in spark.read.parquet(str(x)).columns for x in made)


def test_seed_metadata_deals_out_no_texts_and_no_copies_of_probes(spark, small):
    """Each document's vector is dealt out once, those of probes not once for each part, and only those on which members are compared."""
    scratch = Path(scratch_dir(spark))
    before = set(scratch.glob("*"))
    plan = registry.QUERIES["d15_seed_metadata"](spark, small)
    made = set(scratch.glob("*")) - before
    tables = {label: spark.read.parquet(str(next(x for x in made if x.name.startswith(label)))) for label in ("metadata-anchors", "metadata-probes", "metadata-scores")}
    assert "text" not in tables["metadata-anchors"].columns
    assert tables["metadata-probes"].count() < tables["metadata-anchors"].select("doc").distinct().count() * 0.6
    assert plan.columns == ["seed", "other"] and not [x for x in made if x.name.startswith("metadata-vectors")]


@pytest.mark.parametrize("entries", [20, 1 << 20])
def test_seed_pairs_are_those_of_members(spark, monkeypatch, entries):
    monkeypatch.setattr(metadata, "ENTRIES", entries)
    rng = random.Random(8)
    texts = list(random_texts(24).values())
    rows = [(rng.choice(["base", "ethereum", "solana"]), f"c{rng.randint(0, 5)}", rng.choice(["1", "2", "03", "3", "10", "x", "1x"]), "n", "t", "i", rng.choice([*texts, None, ""]), i) for i in range(90)]
    own = spark.createDataFrame(rows, SCHEMA)
    anchors = metadata.anchors(metadata.numbered(own), "doc", "doc")
    left = anchors.where("contract like '%/c1' or contract like '%/c2'").select("contract").distinct()
    members = anchors.join(left, "contract").select("member").distinct()
    text = {r.doc: r.body for r in metadata.numbered(own).select("doc", "body").collect() if r.body is not None}
    near = [(a, b) for a, b in itertools.permutations(text, 2) if text[a] and text[b] and brute_bm25(text[a], text[b]) >= 0.2]
    links = spark.createDataFrame(near, anchors.select(F.col("doc"), F.col("doc").alias("peer")).schema)
    want = {tuple(r) for r in metadata.member_pairs(anchors, links, members).collect()}
    got = [tuple(r) for r in metadata.seed_pairs(own, anchors, 0.2, left).collect()]
    assert len(got) > 20 and any("solana" not in a + b for a, b in got) and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("visited", [50, 250_000])
def test_rarest_terms_of_either_side_lose_no_match(monkeypatch, visited):
    """Documents of a few thousand terms, of which a match shares many or few: candidates hold every match of brute force."""
    monkeypatch.setattr(metadata, "VISITED", visited)
    rng = random.Random(4)
    words = [[f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([3, 30, 400]))] for _ in range(40)]
    for own in words[:30]:
        words.append([w if rng.random() < 0.85 else f"v{rng.randint(0, 4000)}" for w in own] + [f"u{k}" for k in range(rng.choice([0, len(own) // 2]))])
    counts = [{hash(w) % (1 << 64): own.count(w) for w in own} for own in words]
    texts = [" ".join(own) for own in words]

    def packed(docs):
        pairs = [sorted(x.items()) for x in docs]
        return tuple(metadata.np.array(x, kind).tobytes() for x, kind in (([len(p) for p in pairs], "u4"), ([k for p in pairs for k, _ in p], "u8"), ([v for p in pairs for _, v in p], "u1")))

    index = metadata._Index(metadata._Vectors(packed(counts[:35]), packed(counts[35:])), 0.2)
    visitors = metadata._Vectors(packed(counts[::3]))
    found = {(i * 3, j): x for a, b, score in index.matches(visitors, lambda i, j: i * 3 != j) for i, j, x in zip(a.tolist(), b.tolist(), score.tolist(), strict=True)}
    want = {(i, j): brute_bm25(texts[i], texts[j]) for i in range(0, 70, 3) for j in range(70) if i != j}
    want = {k: v for k, v in want.items() if v >= 0.2}
    assert len(want) > 10 and found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_contract_pairs_are_those_of_members(spark):
    rng = random.Random(3)
    texts = list(random_texts(14).values())
    rows = [(rng.choice(["base", "ethereum", "solana"]), f"c{rng.randint(0, 5)}", str(rng.randint(1, 3)), "n", "t", "i", rng.choice([*texts, None]), i) for i in range(70)]
    own = spark.createDataFrame(rows, SCHEMA)
    anchors = metadata.anchors(metadata.numbered(own), "doc", "doc")
    links = metadata.numbered_links(own, anchors, 0.6)
    old = metadata.with_documents(metadata.anchors(own))
    assert {tuple(r) for r in links.collect()} == {tuple(r) for r in metadata.document_links(old, 0.6).collect()}
    left = anchors.where("contract like '%/c1' or contract like '%/c2'").select("contract").distinct()
    probes = {tuple(r.doc) for r in anchors.join(left, "contract").select("doc").collect()}
    seeded = metadata.numbered_links(own, anchors, 0.6, anchors.join(left, "contract").select("doc").distinct())
    assert {tuple(r) for r in seeded.collect()} == {tuple(r) for r in links.collect() if tuple(r.doc) in probes or tuple(r.peer) in probes}
    contract = anchors.select("member", "contract").distinct()
    want = metadata.member_pairs(anchors, links, contract.join(left, "contract").select("member"))
    want = want.join(contract.toDF("left", "l"), "left").join(contract.toDF("right", "r"), "right").select("l", "r").distinct()
    got = [tuple(r) for r in metadata.contract_pairs(anchors, links, left).collect()]
    assert len(got) > 10 and len(got) == len(set(got)) and set(got) == {tuple(r) for r in want.collect()}


def test_scores_of_a_cluster_take_each_vector_once(spark):
    """All pairs of 60 documents and of 40 others: two cells, and 100 rows of vectors, not one for each of 2550 pairs."""
    texts = {i: f"{'red fox jumps over lazy dogs' if i < 60 else 'blue whale swims under calm seas'} number {i}" for i in range(100)}
    docs = spark.createDataFrame([*texts.items(), (500, "another text"), (501, None)], "doc long, text string")
    pairs = [(a, b) for a, b in itertools.combinations(range(100), 2) if (a < 60) == (b < 60)]
    frame = spark.createDataFrame(pairs, "left long, right long")
    cells = metadata.scoring_cells(frame).collect()
    assert sorted((r.left, r.right) for r in cells) == pairs and len({r.cell for r in cells}) == 2
    got = {(r.left, r.right): r.score for r in metadata.vector_scores(docs, frame).collect()}
    assert got.keys() == set(pairs) and all(abs(got[p] - brute_bm25(texts[p[0]], texts[p[1]])) < 1e-9 for p in pairs[::37])
    some = spark.createDataFrame([(i,) for i in (0, 7, 99)], "doc long")
    near = {r.doc for r in metadata.likely(docs, some).collect()}
    assert {0, 7, 99} <= near and len(near) < 10


def test_hits_of_nfts_are_arrays_and_count_as_scopes(spark):
    """One row an NFT, not one a scope, and rows are dealt out once for each URI."""
    rng = random.Random(7)
    rows = [(rng.choice(["base", "ethereum", "polygon", "solana"]), f"c{rng.randint(0, 3)}", "", rng.choice([None, "", *(f"t{i}" for i in range(60))]), rng.choice([None, "", *(f"i{i}" for i in range(25))]), "") for _ in range(150)]
    own = nfts(spark, rows)
    got = uri.nft_hits(own)
    assert got.count() == 150
    for kind, want in (("token_hits", uri.token_uri_scopes(own)), ("image_hits", uri.image_uri_scopes(own))):
        found = got.select("chain", "contract", F.explode(kind).alias("s")).select("chain", "contract", "s.*")
        counted = scopes(found.groupBy("scope", "chain", "peer").agg(F.countDistinct("contract").alias("contracts"), F.count(F.lit(1)).alias("nfts")))
        assert len(counted) > 10 and counted == scopes(want)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 12


def test_duplicate_scale_counts_an_id_once(spark, small, tmp_path):
    """Rows that repeat an id, as SQL counts them; no table of the query has a row for each scope of an NFT."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.unionByName(docs.where("doc_id % 7 < 2")).unionByName(docs.where("doc_id % 11 = 0").withColumn("source", F.lit("other"))).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(Path(scratch_dir(spark)).glob("duplicate-nfts*"))
    columns = ["kind", "scope", "chain", "peer", "contracts", "nfts", "total_contracts", "total_nfts"]
    got = {tuple(r[c] for c in columns) for r in registry.QUERIES["d18_duplicate_scale"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES['d18_duplicate_scale']})").fetchall())
    (made,) = set(Path(scratch_dir(spark)).glob("duplicate-nfts*")) - before
    every = spark.read.parquet(str(made))
    assert every.count() <= docs.count() * 2 and every.columns == ["chain", "contract", "row_order", "hits"]
