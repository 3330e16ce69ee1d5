"""Similarity of names (Jaro-Winkler) and of metadata (pairwise BM25 cosine), with bounds that lose no match."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed values of the two measures.
K1, B = 1.2, 0.75
IDF_ONCE, IDF_SHARED = math.log(2.0), math.log(1.2)
PREFIX, SCALE, BOOST = 4, 0.1, 0.7


def jaro_winkler(a: str, b: str) -> float:
    """0 to 1; the common prefix (4 letters at most) counts only above a Jaro similarity of 0.7."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    taken, hit_a = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hit_a.append(c)
                break
    if not hit_a:
        return 0.0
    hit_b = [c for c, t in zip(b, taken, strict=True) if t]
    k = len(hit_a)
    moved = sum(x != y for x, y in zip(hit_a, hit_b, strict=True)) // 2
    jaro = (k / n + k / m + (k - moved) / k) / 3
    if jaro <= BOOST:
        return jaro
    same = 0
    for x, y in zip(a[:PREFIX], b[:PREFIX], strict=False):
        if x != y:
            break
        same += 1
    return jaro + SCALE * same * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)), float, len(a)))


def best_from_overlap(n: int, m: int, overlap: int) -> float:
    """The most that the similarity can be for lengths n and m with so many letters in common."""
    if not n or not m or not overlap:
        return 1.0 if n == m == 0 else 0.0
    jaro = (overlap / n + overlap / m + 1) / 3
    return min(1.0, jaro + SCALE * min(overlap, PREFIX) * (1 - jaro)) if jaro > BOOST else jaro


def least_overlap(n: int, m: int, threshold: float) -> int:
    """Letters (as a multiset) that names of lengths n and m must share to reach the threshold; n + m + 1 if none do."""
    for overlap in range(min(n, m) + 1):
        if best_from_overlap(n, m, overlap) >= threshold - 1e-12:
            return overlap
    return n + m + 1


def letter_tokens(name: Column) -> Column:
    """Each letter with its running number among equal letters: sets of these meet like multisets of letters."""
    letters = F.split(name, "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda d: d == c)).cast("string")))


def weight(tf: Column, length: Column, mean_length: Column, idf: float) -> Column:
    """A term's BM25 weight in a document of the pair."""
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(mean_length, F.lit(1.0))))
