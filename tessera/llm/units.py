"""Cutting text into pieces that a byte-level BPE treats alone, with caches.

Text is first cut at single spaces into units; a unit keeps the space before it. That commutes with the tokenizer's own
pattern except where a space stands between two white-space characters or ends the text after one; such texts go
through the pattern whole. A unit's encoded form is looked up, and only units not seen before are cut by the pattern.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import regex

#: White space other than the space and the line feed, and the places that units must not be cut at.
RARE_SPACE = re.compile(r"[^\S \n]")
AWKWARD = regex.compile(r"\s (?!\S)")
#: The usual pattern, and what it comes to for units of these characters only (the standard library's engine is faster).
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
LATIN_USUAL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
#: A unit that is one piece under the usual pattern: a space and letters; and what stands behind the space.
SPACED_WORD = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+")
WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A word and one mark behind it, which are two pieces.
MARKED_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[,.;:!?]")
#: Longer units are not kept: they would fill the cache with whole texts.
LONG_UNIT = 200


RARE_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


def awkward(text: str) -> bool:
    """Whether units of this text would be cut otherwise than the whole text is."""
    rare = any([c in text for c in RARE_ASCII]) if text.isascii() else RARE_SPACE.search(text)
    if "  " in text or "\n " in text or rare:
        return AWKWARD.search(text) is not None
    return False


def missing(found: list) -> list[int]:
    """The places of None."""
    out, at = [], -1
    try:
        while True:
            at = found.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


class PieceCodec:
    """Encodes texts to bytes of little-endian 32-bit ids through caches of two generations.

    A cache that is full becomes the old generation, and what the old one had and nobody asked for again is forgotten: so
    common words stay, and memory stays bounded however many words there are.

    ``encode`` turns distinct pieces (matches of ``pattern``), and words that stand for a piece with a space before it, into
    a list of such bytes, the pieces' first.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str], list[str]], list[bytes]], limit: int = 450_000) -> None:
        self.pattern, self.encode, self.limit = regex.compile(pattern), encode, limit
        self.usual = pattern == USUAL
        #: Ids of pieces other than a space and a word.
        self.pieces: dict[str, bytes] = {}
        #: Ids of what stands between two spaces, together with the space before it.
        self.spaced: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def cut(self, unit: str) -> list[str]:
        if self.usual and LATIN.fullmatch(unit):
            return LATIN_USUAL.findall(unit)
        return self.pattern.findall(unit)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of every text."""
        if len(self.pieces) > self.limit // 2:
            self.pieces = {}
        if len(self.spaced) > self.limit:
            self.old, self.spaced = self.spaced, {}
        # many small lists live until the end of the call: looking for cycles among them again and again takes long
        enabled = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if enabled:
                gc.enable()

    def _back(self, units: set[str]) -> set[str]:
        """Takes what the old generation knows over; what it doesn't know is returned."""
        if not self.old:
            return units
        known = units & self.old.keys()
        self.spaced.update(zip(known, map(self.old.__getitem__, known)))
        return units - known

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [[t] if awkward(t) else t.split(" ") for t in texts]
        heads = [own.pop(0) for own in cut]
        spaced = self.spaced
        # every unit is looked up once; the places of those not known are filled in at the end
        made_of = [list(map(spaced.get, own)) for own in cut]
        gaps = [(known, i, own[i]) for own, known in zip(cut, made_of, strict=True) for i in missing(known)]
        new = self._back({u for _, _, u in gaps})
        words = set(filter(WORD.fullmatch, new)) if self.usual else set()
        new -= words
        marked = set(filter(MARKED_WORD.fullmatch, new)) if self.usual else set()
        found = [(u, self.cut(" " + u)) for u in new - marked]
        first = {h: self.cut(h) for h in set(heads)}
        needed = set().union(*[own for _, own in found], *first.values(), {u[-1] for u in marked})
        if self.usual:  # words of longer units are kept as words, too
            inner = set(filter(SPACED_WORD.fullmatch, needed))
            needed -= inner
            words.update([p[1:] for p in inner], [u[:-1] for u in marked])
            words = self._back(words.difference(spaced))
        needed = needed.difference(self.pieces)
        made = self.encode(list(needed), list(words)) if needed or words else []
        self.pieces.update(zip(needed, made))
        spaced.update(zip(words, made[len(needed) :], strict=True))
        pieces = self.pieces

        def ids_of(own: list[str]) -> bytes:
            return b"".join([pieces[p] if p in pieces else spaced[p[1:]] for p in own])

        for u in marked:
            spaced[u] = spaced[u[:-1]] + pieces[u[-1]]
        long = []
        for u, own in found:
            spaced[u] = ids_of(own)
            if len(u) > LONG_UNIT:
                long.append(u)
        for known, i, u in gaps:
            known[i] = spaced[u]
        out = [b"".join([ids_of(first[h]), *known]) for h, known in zip(heads, made_of, strict=True)]
        for u in long:
            del spaced[u]
        for p in [p for p in needed if len(p) > LONG_UNIT]:
            del pieces[p]
        for u in [u for u in (*words, *marked) if len(u) > LONG_UNIT]:
            spaced.pop(u, None)
        return out
