"""FLAC round trips and damage, wrapper induction, Merkle fingerprints."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import flac, html, merkle

RNG = random.Random(5)


def blobs():
    noise = np.random.default_rng(1)
    return [bytes(64), noise.bytes(5000), bytes(range(256)) * 9, bytes([255, 0] * 2500), b"a" * 64 + b"b", b"x", bytes(int(128 + 100 * np.sin(i / 9)) for i in range(5000)), bytes(i // 20 % 256 for i in range(300_000)), "été — 你好\n".encode() * 400]


def test_flac_round_trip():
    data = blobs()
    streams = flac.encode(data)
    for got, want in zip(flac.decode(streams), data, strict=True):
        assert b"".join(b for _, b in got) == want
        assert [first for first, _ in got] == list(range(0, len(want), flac.BLOCK))
    assert len(streams[6]) < 0.5 * len(data[6])


def test_flac_without_seek_table():
    data = blobs()[6]
    stream = flac.encode([data])[0]
    body = flac.parse(stream)[2]
    bare = stream[:4] + bytes([0x80]) + stream[5:42] + stream[body:]
    assert b"".join(b for _, b in flac.decode([bare])[0]) == data


def test_flac_reads_sparse_seek_tables_and_spans():
    for data in blobs():
        stream = flac.encode([data])[0]
        info, seek, body = flac.parse(stream)
        for step in (2, 3, 100):
            points = seek[::step][1:] if step == 2 else seek[::step]
            table = points.tobytes() + (b"\xff" * 8 + bytes(10)) * 2  # placeholders
            sparse = stream[:42] + bytes([0x83]) + len(table).to_bytes(3, "big") + table + stream[body:]
            assert b"".join(b for _, b in flac.decode([sparse, stream])[0]) == data
            for first, count in ((0, 1), (1000, 2000), (len(data) - 1, 50), (len(data) + 5, 3), (flac.BLOCK, flac.BLOCK)):
                assert flac.samples_at(sparse, first, count) == data[first : first + count]
        wrong = seek.copy()
        wrong["sample"][-1] += 7
        with pytest.raises(ValueError):
            flac.decode([stream[:46] + wrong.tobytes() + stream[body:]])


def test_flac_encoder_uses_linear_prediction():
    rng = np.random.default_rng(2)
    x = np.zeros(4096)
    for i in range(2, len(x)):
        x[i] = 1.6 * x[i - 1] - 0.9 * x[i - 2] + rng.normal(0, 3)
    data = np.clip(x + 128, 0, 255).astype(np.uint8).tobytes()
    stream = flac.encode([data])[0]
    _, seek, body = flac.parse(stream)
    kinds = {stream[flac.read_header(stream, body + int(p["offset"]))[2]] >> 1 for p in seek}
    assert kinds == {flac.LPC + flac.ORDER - 1} and b"".join(b for _, b in flac.decode([stream])[0]) == data
    texts = [" ".join(RNG.choice(["alpha", "beta", "Gamma,", "δ"]) for _ in range(RNG.randint(1, 2000))).encode() for _ in range(30)]
    assert [b"".join(b for _, b in own) for own in flac.decode(flac.encode(texts))] == texts


def framed(fields, n, number=0):
    frame = flac.frame_header(n, number) + bits(*fields)
    c = int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    return frame + c.to_bytes(2, "big")


def stream_of(x, n, *frames):
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(np.array(x, np.int8).tobytes()).digest()
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + info + b"".join(frames)


def test_flac_reads_escaped_partitions_wasted_bits_and_wide_parameters():
    x = [RNG.randint(-60, 60) for _ in range(256)]
    coded = [x[0], *(b - a for a, b in zip(x, x[1:]))]
    escaped = [(0, 1), (flac.FIXED + 1, 6), (0, 1), (x[0], 8), (0, 2), (1, 4), (15, 4), (9, 5), *((v, 9) for v in coded[1:128]), (5, 4)]
    for v in coded[128:]:
        escaped += rice(v, 5)
    wide = [(0, 1), (flac.FIXED + 1, 6), (0, 1), (x[0], 8), (1, 2), (0, 4), (6, 5)]
    for v in coded[1:]:
        wide += rice(v, 6)
    even = [2 * v for v in range(-30, 30)] * 4 + [0] * 16
    wasted = [(0, 1), (flac.VERBATIM, 6), (1, 1), (1, 1), *((v // 2, 7) for v in even)]
    constant = [(0, 1), (flac.CONSTANT, 6), (0, 1), (-9, 8)]
    samples = x + x + even + [-9] * 256
    frames = [framed(f, 256, k) for k, f in enumerate((escaped, wide, wasted, constant))]
    got = flac.decode([stream_of(samples, 256, *frames)])[0]
    assert [a for a, _ in got] == [0, 256, 512, 768] and b"".join(b for _, b in got) == bytes(v + 128 for v in samples)
    with pytest.raises(ValueError):  # frames in the wrong order
        flac.decode([stream_of(samples, 256, *frames[::-1])])


def bits(*fields):
    out = "".join(f"{v & (1 << n) - 1:0{n}b}" for v, n in fields)
    out += "0" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big")


def rice(v, k):
    u = v << 1 if v >= 0 else (-v << 1) - 1
    return [(1, (u >> k) + 1), (u, k)]


def test_flac_reads_linear_prediction_and_partitions():
    x = [int(60 * np.sin(i / 5)) for i in range(256)]
    factors, shift = [15, -8], 3
    residual = [x[i] - ((15 * x[i - 1] - 8 * x[i - 2]) >> shift) for i in range(2, 256)]
    fields = [(0, 1), (flac.LPC + 1, 6), (0, 1), (x[0], 8), (x[1], 8), (5 - 1, 4), (shift, 5), (factors[0], 5), (factors[1], 5), (0, 2), (1, 4), (3, 4)]
    for i, r in enumerate(residual):
        if i + 2 == 128:
            fields.append((4, 4))
        fields += rice(r, 3 if i + 2 < 128 else 4)
    head = flac.frame_header(256, 0)
    frame = head + bits(*fields)
    c = int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    frame += c.to_bytes(2, "big")
    info = (256).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 256).to_bytes(8, "big") + hashlib.md5(np.array(x, np.int8).tobytes()).digest()
    stream = b"fLaC" + bytes([0x80, 0, 0, 34]) + info + frame
    assert np.frombuffer(flac.decode([stream])[0][0][1], np.uint8).tolist() == [v + 128 for v in x]


def test_flac_notices_damage():
    stream = bytearray(flac.encode([blobs()[8]])[0])
    for at in (-50, -700, 60):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    for cut in range(len(stream) - 1, 50, -97):
        with pytest.raises(ValueError):
            flac.decode([bytes(stream[:cut])])
    with pytest.raises(ValueError):
        flac.decode([b"RIFF"])


@pytest.mark.parametrize("rows", [[(1, "a"), (1, "a"), (2, None), (3, ""), (None, "é" * 100_000), (4, "x" * 64)], []])
def test_media_query(spark, rows):
    docs = spark.createDataFrame([(d, t, b"m") for d, t in rows], "doc_id long, text string, media binary")
    got = flac.digest(flac.store(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (next(t for d, t in rows if d == r.doc_id) or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    from pyspark.sql import functions as F

    cut = flac.spans(flac.store(docs), F.lit(3), F.lit(70)).collect()
    assert sorted(len(r.pcm) for r in cut) == sorted(min(70, r.payload_bytes - 3) for r in got)
    pcm = flac.blocks(flac.store(docs)).collect()
    assert sum(len(r.pcm) for r in pcm) == sum(r.payload_bytes for r in got)


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p><article>";</script></head><body class="has-sidebar">
<div id="cookieNotice">We use cookies</div><header><h1>Site</h1><nav><a href=/>home</a></nav></header>
<main><article><h1>Title {i} &amp; more</h1><p>First <b>bold{i}</b>text<br>of page {i}.<p>Second   para{i}
<div class="share-buttons">Share me</div><div>Follow us on all channels</div><ul><li>one{i}<li>two</ul>
<section class="comments"><p>nice post {i}</p></section></article></main>
<aside>side {i}</aside><form>mail</form><footer>&copy; {i}</footer></body></html>"""


def test_html_markup_only():
    got = html.main_text(html.parse(PAGE.replace("{i}", "7")))
    assert got == "Title 7 & more First bold7text of page 7. Second para7 Follow us on all channels one7 two"


@pytest.mark.parametrize("small", [10**9, 0])
def test_wrapper_induction_drops_constant_nodes(spark, small):
    rows = [(i, f"http://a.example/{i}", PAGE.replace("{i}", str(i)), "clash") for i in range(8)] + [(100, "http://b.example/", PAGE.replace("{i}", "1"), "x"), (101, "no url", "<p>alone", "y"), (102, None, None, None), (103, "http://a.example/z", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(pages, small).collect()}
    for i in range(8):
        assert got[i] == f"Title {i} & more First bold{i}text of page {i}. Second para{i} one{i} two" or got[i] == f"Title {i} & more First bold{i}text of page {i}. Second para{i} one{i}"
    assert got[100].startswith("Title 1 & more") and got[101] == "alone" and got[102] == "" and got[103] == ""


def test_html_keeps_every_part_that_nothing_rules_out():
    def text(page):
        return html.main_text(html.parse(page))

    long, short = "long " * 200, "short " * 30
    assert text(f"<body><article><p>{long}</article><article><p>{short}</article><p>outside") == f"{long}{short}".strip()
    assert text("<body><p>One.</p><p>See <a href=x>all that is linked here, at length</a>.</p>") == "One. See all that is linked here, at length."
    for tag in ("svg", "math"):
        assert text(f"<body><p>Before <{tag} class='i'/> after</p><p>Next</p>") == "Before after Next"
        assert text(f"<body><p>Before</p><{tag} /><p>Next</p><{tag}>drawn</{tag}><p>Last</p>") == "Before Next Last"


def test_html_copies_keep_their_article(spark):
    rows = [(i, "http://c.example/x", PAGE.replace("{i}", "1")) for i in range(9)]
    assert {r.text != "" for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {True}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def tree_size(a, b):
    """Simple tree matching by its recursion."""
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + tree_size(x[i], y[j]))
    return m[-1][-1] + 1


def test_tree_matching_equals_recursion():
    def random_tree(depth):
        return (RNG.choice("ab"), tuple(random_tree(depth - 1) for _ in range(RNG.randint(0, 3)))) if depth else ("a", ())

    def shape(tree, matcher):
        x = html.Shape(tree[0])
        x.parts = [shape(c, matcher) for c in tree[1]]
        return matcher.close(x)

    for _ in range(60):
        matcher = html.Matcher()
        a, b = random_tree(3), random_tree(3)
        x, y = shape(a, matcher), shape(b, matcher)
        assert matcher.size(x, y) == tree_size(a, b) == 1 + sum(matcher.size(x.parts[i], y.parts[j]) for i, j in matcher.pairs(x.parts, y.parts)) * (a[0] == b[0]) - (a[0] != b[0])
        again = html.read(html.written(x), matcher)
        assert again.key == x.key
        merged = matcher.merge(again, shape(b, matcher)) if a[0] == b[0] else again
        assert -1 not in matcher.places(x, merged) and (a[0] != b[0] or -1 not in matcher.places(y, merged))


def test_html_reads_hostile_markup_in_linear_time():
    import time

    for bad in ("<a \"", "<a x=\"", "<a x='>\"", "<svg>", "<!--", "</", "<b>", "</b>", "<p <", "<a =\"'>"):
        began = time.perf_counter()
        html.blocks(html.parse(bad * 40_000 + "end"))
        assert time.perf_counter() - began < 4, bad
    assert html.main_text(html.parse('<p>one</p><a href="x>two</a><p>three')) == "one two three"


def plain(page):
    """The page without the tags, classes, ids and roles that say what is what."""
    import re

    page = re.sub(r"<(/?)(?:article|nav|header|footer|aside|form|main|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]*)", "", page)


def test_wrapper_induction_finds_the_main_text_without_markup(spark):
    rng = random.Random(4)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))

    menus, adverts, notes = ([words(n) for _ in range(4)] for n in (8, 10, 6))
    rows, want = [], {}
    for i in range(240):
        host = f"h{i % 3}.example" if i < 200 else f"small{i % 8}.example"
        title, paragraphs = words(5), [words(rng.randint(4, 40)) for _ in range(rng.randint(1, 6))]
        items = "".join(f"<li><a href=/x>{w}</a></li>" for w in rng.choice(menus).split())
        extra = f"<div class=promo><b>{rng.choice(adverts)}</b></div>" if rng.random() < 0.6 else ""
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f"<html><head><title>{title}</title></head><body><nav><ul>{items}</ul></nav>{extra}<article id=post-{i}><h1>{title}</h1>{body}</article><footer>&copy; {host} {rng.choice(notes)}</footer></body></html>"
        rows.append((i, f"https://{host}/{i}", plain(page)))
        want[i] = " ".join([title, *paragraphs])
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    markup_only = {i: html.main_text(html.parse(h)) for i, _, h in rows}
    assert not any(markup_only[i] == want[i] for i in want)


def test_copies_of_an_article_are_no_template(spark):
    rows = [(i, "http://c.example/", f"<body><div><ul><li>home</li><li>news</li></ul></div><div><h1>T{i % 3}</h1><p>{'same ' * 30}</p><p>{'again ' * 9}</p></div>") for i in range(30)]
    rows += [(100 + i, "http://c.example/", f"<body><div><ul><li>home</li><li>news</li></ul></div><div><h1>U{i}</h1><p>{f'w{i} ' * 30}</p></div>") for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "T0 " + "same " * 30 + "again " * 8 + "again" and got[103].startswith("U3 w3")


def test_html_deep_and_broken():
    deep = "<div>" * 20_000 + "x"
    assert html.main_text(html.parse(deep)) == "x"
    assert html.main_text(html.parse("a<!-- b <p>c")) == "a"
    assert html.main_text(html.parse("<p>a < b &lt; c <3</p></div>d<script>e")) == "a < b < c <3 d"


def test_deep_pages_do_not_break_induction(spark):
    deep = ["<header>" + "<div class=x>" * 5000 + f"page {i}" + "</div>" * 5000 + f"</header><main><div><p>text {i}" for i in range(6)]
    rows = [(i, "http://d.example/", h) for i, h in enumerate(deep)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"text {i}" for i in range(6)}


def test_merkle_tests_equality_and_locates_edits():
    text = "\n".join(" ".join(RNG.choice("abcdefgh") * RNG.randint(1, 6) for _ in range(30)) for _ in range(20))
    words = text.replace("\n", " \n ").split(" ")
    at = 311
    other = words.copy()
    other[at] = "EDIT"
    changed = " ".join(other).replace(" \n ", "\n")
    prints = merkle.Trees([text, changed, text], merkle.Hashes()).fingerprints()
    assert prints[0] == prints[2] != prints[1]
    spans = merkle.word_spans(changed, merkle.differing(prints[1], prints[0]))
    assert any(a <= at < b for a, b in spans) and sum(b - a for a, b in spans) <= 3 * merkle.LONGEST
    assert merkle.likeness([prints[0]], [prints[1]])[0] > 0.95 and merkle.likeness([prints[0]], [prints[2]])[0] == 1
    assert sum(len(x) for x in merkle.leaf_words(text)) == len(words) and merkle.differing(prints[0], prints[2]) == []


def brute_tree(text):
    """Root, sections as lists of paragraphs, and leaves, from the definition."""
    sections, own = [], []
    paragraphs = text.split("\n")
    for k, p in enumerate(paragraphs):
        h = hashlib.blake2b(p.encode(), digest_size=16).digest()
        own.append(h)
        if int.from_bytes(h[8:], "big") % merkle.SECTION == 0 or k + 1 == len(paragraphs):
            sections.append(own)
            own = []
    hashes = [hashlib.blake2b(b"".join(s), digest_size=16).digest() for s in sections]
    return hashlib.blake2b(b"".join(hashes), digest_size=16).hexdigest(), list(zip(hashes, sections, strict=True)), merkle.leaf_words(text)


def brute_likeness(x, y):
    """Shared leaves, a section or a paragraph that both have being shared as a whole."""
    (ra, sa, la), (rb, sb, lb) = brute_tree(x), brute_tree(y)
    if ra == rb:
        return 1.0
    def leaves(sections, words):
        at, out = 0, []
        for h, paragraphs in sections:
            of = []
            for p in paragraphs:
                n = at
                while True:
                    n += 1
                    if n == len(words) or words[n - 1][-1] == "\n":
                        break
                of.append((p, [tuple(w) for w in words[at:n]]))
                at = n
            out.append((h, of))
        return out
    from collections import Counter

    a, b = leaves(sa, la), leaves(sb, lb)
    shared = 0
    for level in range(3):
        if level == 1:
            a, b = ([p for _, of in z for p in of] for z in (a, b))
        if level == 2:
            a, b = ([(w, [w]) for _, of in z for w in of] for z in (a, b))
        both = Counter(h for h, _ in a) & Counter(h for h, _ in b)
        size = {h: sum(len(p[1]) for p in of) if level == 0 else len(of) for h, of in a}
        shared += sum(n * size[h] for h, n in both.items())
        for z in (a, b):
            left = both.copy()
            keep = []
            for item in z:
                if left[item[0]]:
                    left[item[0]] -= 1
                else:
                    keep.append(item)
            z[:] = keep
    return min(2 * shared / (len(la) + len(lb)), 1 - 1e-9)


def test_merkle_likeness_follows_branches():
    def text(n):
        return "\n".join(" ".join(RNG.choice(["ab", "cd", "e", ""]) for _ in range(RNG.randint(0, 12))) for _ in range(n))

    for _ in range(60):
        a = text(RNG.randint(1, 12))
        lines = a.split("\n")
        lines[RNG.randrange(len(lines))] = text(RNG.randint(1, 2))
        b = RNG.choice(["\n".join(lines), text(4)])
        x, y = merkle.Trees([a, b], merkle.Hashes()).fingerprints()
        root, sections, leaves = brute_tree(a)
        p = merkle.Print(x)
        assert (p.root, p.section["n"].tolist(), len(p.leaf)) == (root, [len(s) for _, s in sections], len(leaves))
        assert p.section["h"].tolist() == [int.from_bytes(h[:8], "big") for h, _ in sections]
        assert abs(merkle.likeness([x], [y])[0] - brute_likeness(a, b)) < 1e-12
        assert (x == y) == (a == b)


def test_merkle_tells_white_space_apart():
    texts = ["a b", "a  b", "a\nb", "a \n b", "ab", "", " ", "\n"]
    assert len(set(merkle.Trees(texts, merkle.Hashes()).fingerprints())) == len(texts)


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_fingerprint_query_equals_brute_force(spark, ranges):
    rows = [(d, " ".join(RNG.choice(["x", "yy", "zzz", "été"]) for _ in range(RNG.randint(0, 60))) or None) for d in RNG.sample(range(-50, 1000), 70)] + [(2000, "same text here"), (2000, "same text here"), (None, "null id")]
    docs = spark.createDataFrame([(d, t, "f") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = merkle.fingerprints(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        changed = merkle.edited(t, after)
        a, b, c = merkle.Trees([t, changed, after], merkle.Hashes()).fingerprints()
        want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, round(merkle.likeness([a], [b])[0], 9), round(merkle.likeness([a], [c])[0], 9)))
    assert sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got), key=repr) == sorted(want, key=repr)


def test_fingerprints_of_nothing_and_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert merkle.fingerprints(empty).count() == 0
    r = merkle.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


assert re
