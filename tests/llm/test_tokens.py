"""Byte-level BPE against tiktoken, packing against the rules, both with awkward texts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe, packing
from tessera.llm.units import PieceCodec, awkward

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
RNG = random.Random(1)
ODD = ["", " ", "  ", "a  b", "a   b ", "\n \n", "a \n b\n\n  c \t x", "x" * 5000, "ab" * 3000, "don't I'LL we'll", "　 a\xa0 b  c", "مرحبا 你好世界 😀😀", "\x00\x01 \x1c b", "\r\n \r\n a", "<|endoftext|> a", "é" * 700 + "  " + "1234567890" * 100]
ODD += ["".join(RNG.choice("ab \n\t'.1é\xa0") for _ in range(RNG.randint(1, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_tiktokens(library):
    ranks, cut = bpe.codec(MULTI, P.PATTERN)
    for text, ids in zip(ODD, cut(ODD), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode_ordinary(text)
        assert ranks.decode(ids) == text.encode()


def test_matrix_and_heap_merge_alike():
    ranks, _ = bpe.codec(MULTI, P.PATTERN)
    pieces = ["".join(RNG.choice("abcdeé ") for _ in range(RNG.randint(1, 60))).encode() for _ in range(300)]
    assert [ranks.merge_long(p) for p in pieces] == [ranks.merge_matrix([p])[0] for p in pieces]


def test_caches_stay_bounded(library):
    codec = PieceCodec(P.PATTERN, lambda pieces, words: bpe.codec(MULTI, P.PATTERN)[0].encode_pieces([*pieces, *[" " + w for w in words]]), limit=5)
    for text in ODD[:60]:
        assert np.frombuffer(codec([text])[0], np.uint32).tolist() == library.encode_ordinary(text)
        assert all(len(k) <= 200 for k in codec.spaced)


def test_awkward_spaces():
    assert awkward("a \n b \n") is False and awkward("\n \n") and awkward("x  ") and awkward("\xa0 ") and not awkward("a b")


@pytest.mark.parametrize("rows", [[(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "w " * 30_000)], []])
def test_round_trip_query(spark, rows, library):
    docs = spark.createDataFrame([(d, t, b"x", 5) for d, t in rows], "doc_id long, text string, ids binary, n_tokens int")
    got = bpe.round_trip(docs, MULTI, P.PATTERN).collect()
    want = [(d, len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got), key=repr) == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(docs, MULTI, P.PATTERN), MULTI, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in rows)


def awkward_texts(n):
    marks = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\u00a0", "\u2003", "\u3000", "'s", "'LL", "'", "1", "٣", "é", "e\u0301", "ß", "你好", "🙂", "👨‍👩‍👧", "\u200b", "a", "The", "ing", ".", "...", "!?", "_", "<|endoftext|>", "\ufffd", "\x00", "x" * 40]
    return ["".join(RNG.choice(marks) for _ in range(RNG.randint(0, 40))) for _ in range(n)] + ["", " ", "a" * 5000, " " * 3000, "ab" * 4000 + " "]


def test_packing_has_the_ids_of_the_tokenizers_library(tmp_path):
    import json

    own = Tokenizer.from_file(PLAIN)
    own.encode_special_tokens = True
    texts = awkward_texts(4000)
    encoder = packing.Encoder(PLAIN, P.PATTERN)
    assert encoder.fast is not None
    want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder(texts) == want
    # a file whose ids do not say how to merge, and another pattern, are left to the library
    file = json.load(open(PLAIN, encoding="utf-8"))
    first, second = ("".join(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"][:2])
    vocabulary = file["model"]["vocab"]
    vocabulary[first], vocabulary[second] = vocabulary[second], vocabulary[first]
    (tmp_path / "other.json").write_text(json.dumps(file), encoding="utf-8")
    other = packing.Encoder(str(tmp_path / "other.json"), P.PATTERN)
    library = Tokenizer.from_file(str(tmp_path / "other.json"))
    library.encode_special_tokens = True
    assert other.fast is None and other(texts[:200]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[:200]]
    assert packing.Encoder(PLAIN, r"\S+|\s+").fast is None


def check_packing(rows, got, size):
    own = Tokenizer.from_file(PLAIN)
    own.encode_special_tokens = True
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for text in {t for _, t in rows}:
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        for d in {d for d, t in rows if t == text}:
            mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d])
            copies = sum(1 for x in rows if x == (d, text))
            want, start, k = [], 0, 0
            for n in ([len(ids) % size] if len(ids) % size else []) + [size] * (len(ids) // size):
                want.append((k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
                start, k = start + n, k + 1
            assert mine == sorted(want * copies)
    for parts in by_bin.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size


@pytest.mark.parametrize("again", [100_000, 7])
@pytest.mark.parametrize(("size", "small"), [(16, 10**6), (2048, 0)])
def test_packing_rules(spark, monkeypatch, size, small, again):
    monkeypatch.setattr(packing, "AGAIN", again)
    rows = [(i, " ".join(RNG.choice(["alpha", "beta", "gamma\n", "d'oh"]) for _ in range(RNG.randint(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "long words " * 2000), (503, "x"), (503, "x")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, piece int, length int").repartition(3)
    got = packing.pack(docs, PLAIN, P.PATTERN, size, small=small).collect()
    check_packing(rows, got, size)
    tokens = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= 1.1 * tokens / size + 3 * 2


def test_bins_that_partitions_leave_open_are_packed_again(spark):
    rows = [(i, "word " * RNG.randint(1, 300)) for i in range(600)]
    counts = {}
    for parts in (1, 60):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = packing.pack(docs, PLAIN, P.PATTERN).collect()
        check_packing(rows, got, 2048)
        counts[parts] = len({r.sequence_id for r in got})
        assert counts[parts] <= sum(r.length for r in got) // 2048 + 2
    assert counts[60] <= counts[1] + 1


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PLAIN, P.PATTERN).count() == 0


def test_bins_choose_the_best_fit_and_close_the_fullest():
    rng = random.Random(3)
    bins, free, number = packing.Bins(50, 4), {}, 0
    for _ in range(2000):
        n = rng.randint(1, 50)
        fits = [f for f in free.values() if f >= n]
        own, offset = bins.place(n)
        if fits:
            assert free[own] == min(fits) and offset == 50 - free[own]
        else:
            if len(free) == 4:
                fullest = min(free.values())
                free.pop(next(k for k in free if free[k] == fullest and all(fullest not in bins.by_free or k not in bins.by_free[fullest] for _ in (0,))))
            assert own == number and offset == 0
            number, free[own] = number + 1, 50
        free[own] -= n
        if not free[own]:
            del free[own]
        assert bins.bits == sum(1 << f for f in set(free.values()))
