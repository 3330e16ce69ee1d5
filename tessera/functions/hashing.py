"""Hashes whose values must equal those of other programs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# FNV-1a with 64 bits, and the multipliers of the mixer and of SplitMix64.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1


def mixed(h: int) -> int:
    h = (h ^ h >> 30) * FIRST & MASK
    h = (h ^ h >> 27) * SECOND & MASK
    return h ^ h >> 31


def token_hash(token: str) -> int:
    """FNV-1a of the UTF-8 bytes, mixed."""
    h = OFFSET
    for b in token.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * PRIME & MASK
    return mixed(h)


@F.pandas_udf(StringType())
def token_hash_udf(tokens: pd.Series) -> pd.Series:
    """As 16 hex digits; each distinct token of a batch is hashed once."""
    known = {t: f"{token_hash(t):016x}" for t in tokens.dropna().unique()}
    return tokens.map(known)


@F.pandas_udf(StringType())
def splitmix64_udf(values: pd.Series) -> pd.Series:
    """SplitMix64 of 64-bit integers, as 16 hex digits."""
    h = values.fillna(0).to_numpy(np.int64).view(np.uint64) + np.uint64(GAMMA)
    h = (h ^ h >> np.uint64(30)) * np.uint64(FIRST)
    h = (h ^ h >> np.uint64(27)) * np.uint64(SECOND)
    h ^= h >> np.uint64(31)
    return pd.Series([f"{x:016x}" for x in h.tolist()]).where(values.notna().to_numpy(), None)


def md5_lower(c: Column) -> Column:
    """The last 8 bytes of the MD5, read with the least significant first, as a decimal number."""
    hexes = F.substring(F.md5(c.cast("binary")), 17, 16)
    return F.conv(F.concat(*(F.substring(hexes, 2 * k + 1, 2) for k in range(7, -1, -1))), 16, 10)
