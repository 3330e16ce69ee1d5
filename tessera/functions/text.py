"""Normalisation of names, URLs, token ids and addresses as column expressions.

Everything is native but for names that need Unicode compatibility forms (NFKC), which go through one Arrow UDF; plain ASCII
names take a chain of regular expressions. Null in, null out, unless said otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that stand for no name, and for no URL.
NULL_LIKE_NAMES = ("none", "null", "nil", "undefined", "n/a", "na", "n.a.", "nan", "-", "--", ".")
NULL_LIKE_URLS = ("nano", "null", "none", "undefined", "n/a", "na", "-", ".", "false", "true", "0")
# Number suffixes that are taken off names, in this order, at most so many times.
TRAILING_NUMBERS = (
    r"\s*#\s*[0-9a-fA-FxX]+\s*$",
    r"\s*#\s*\d+\s*$",
    r"\s*-\s*\d+\s*$",
    r"\s*:\s*\d+\s*$",
    r"\s*\(\s*\d+\s*\)\s*$",
    r"\s*\[\s*\d+\s*\]\s*$",
    r"\s*/\s*\d+\s*$",
    r"\s+No\.?\s*\d+\s*$",
    r"\s+nr\.?\s*\d+\s*$",
    r"\s+\d{1,12}\s*$",
)
MOST_SUFFIXES = 20
# Contracts that belong to platforms.
PLATFORM_CONTRACTS = (
    ("ethereum", "0x7c770595a2be9a87cf49b35ea9bc534f1a59552d"),
    ("ethereum", "0xf3cd1e9326d1965935b287b1ee75c7183359a88a"),
    ("base", "0xf3cd1e9326d1965935b287b1ee75c7183359a88a"),
    ("optimism", "0xf3cd1e9326d1965935b287b1ee75c7183359a88a"),
    ("shape", "0xf3cd1e9326d1965935b287b1ee75c7183359a88a"),
    ("apechain", "0xf3cd1e9326d1965935b287b1ee75c7183359a88a"),
    ("sepolia", "0xf3cd1e9326d1965935b287b1ee75c7183359a88a"),
    ("ethereum", "0x6d9dd3547baf4c190ab89e0103c363feaf325eca"),
    ("ethereum", "0x60f80121c31a0d46b5279700f9df786054aa5ee5"),
    ("ethereum", "0xd07dc4262bcdbf85190c01c996b4c06a461d2430"),
    ("ethereum", "0x09200b963c52d3297a93af71f919e7829c53cf9a"),
)


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def chain_key(c: Column) -> Column:
    return F.lower(trimmed(F.coalesce(c.cast("string"), F.lit(""))))


def address_key(chain: Column, address: Column) -> Column:
    """EVM addresses in lower case; Solana's are case-sensitive."""
    own = trimmed(F.coalesce(address.cast("string"), F.lit("")))
    return F.when(chain_key(chain) == "solana", own).otherwise(F.lower(own))


def usable_name(c: Column) -> Column:
    """False for blank names, words that stand for none, and single digits. Null is false."""
    own = trimmed(F.coalesce(c, F.lit("")))
    return (own != "") & ~F.lower(own).isin(*NULL_LIKE_NAMES) & ~own.rlike("^[0-9]$")


SUFFIXES = [re.compile(p) for p in TRAILING_NUMBERS]
BLANKS = re.compile(r"\s+")


def plain_name(raw: str) -> str:
    """The rule for one name: compatibility form, number suffixes off, white space collapsed, lower case."""
    text = unicodedata.normalize("NFKC", raw).strip()
    for _ in range(MOST_SUFFIXES):
        for pattern in SUFFIXES:
            shorter = pattern.sub("", text, count=1).strip()
            if shorter != text:
                text = shorter
                break
        else:
            break
    return BLANKS.sub(" ", text).strip().lower()


@F.pandas_udf(StringType())
def _unicode_name(names: pd.Series) -> pd.Series:
    return names.map(plain_name, na_action="ignore")


def normalize_name(c: Column) -> Column:
    """Collection name without its token number. Names without digits or beyond ASCII need no UDF."""
    simple = F.lower(trimmed(F.regexp_replace(c, r"\s+", " ")))
    return F.when(c.rlike(r"^[\x00-\x7F]*$") & ~trimmed(c).rlike(r"[0-9a-fA-FxX\)\]]$"), simple).when(c.isNotNull(), _unicode_name(c))


def normalize_text(c: Column) -> Column:
    """Lower case with white space collapsed (ASCII input; compatibility forms need ``normalize_name``)."""
    return F.lower(trimmed(F.regexp_replace(c, r"\s+", " ")))


def _content(prefix: str, value: Column, both: bool) -> Column:
    own = F.regexp_replace(value, r"[?#][\s\S]*$", "")
    own = F.regexp_replace(own, r"^/+|/+$" if both else r"/+$", "")
    return F.when(own != "", F.concat(F.lit(prefix), own))


def normalize_url(c: Column) -> Column:
    """Content address (``ipfs:`` or ``ar:``) where there is one, else the lower-case URL without slashes at its end."""
    own = trimmed(c)
    low = F.lower(own)
    ipfs = F.regexp_extract(own, r"(?i)^https?://[^/]+/ipfs/([A-Za-z0-9][^?#\s]*)", 1)
    arweave = F.regexp_extract(own, r"(?i)^https?://(?:[^/]+\.)?arweave\.net/([A-Za-z0-9_-]{43}(?:/[^?#\s]*)?)", 1)
    return (
        F.when((own == "") | low.isin(*NULL_LIKE_URLS) | low.startswith("data:"), F.lit(None).cast("string"))
        .when(low.startswith("ipfs://"), _content("ipfs:", F.regexp_replace(F.substr(own, F.lit(8)), r"(?i)^ipfs/", ""), True))
        .when(low.startswith("ar://"), _content("ar:", F.substr(own, F.lit(6)), True))
        .when(ipfs != "", _content("ipfs:", ipfs, False))
        .when(arweave != "", _content("ar:", arweave, False))
        .otherwise(F.regexp_replace(low, r"/+$", ""))
    )


def token_key(c: Column) -> Column:
    """A sortable key: decimal ids first, by number of digits and text, then other ids. Numbers may have any length."""
    own = F.regexp_replace(c, r"^0+(?=.)", "")
    numeric = c.rlike(r"^[0-9]+$")
    return F.struct(F.when(numeric, 0).otherwise(1).alias("other"), F.when(numeric, F.length(own)).otherwise(0).alias("digits"), F.when(numeric, own).otherwise(c).alias("text"), c.alias("raw"))


def valid_evm_address(c: Column) -> Column:
    return F.lower(trimmed(c)).rlike("^0x[0-9a-f]{40}$")


def valid_base58_address(c: Column) -> Column:
    """Shape of a Solana address: 32 to 44 letters of the base-58 alphabet."""
    return trimmed(c).rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$")


def platform_contract(chain: Column, address: Column) -> Column:
    key = F.concat_ws("|", F.lower(chain), F.lower(address))
    return key.isin(*(f"{a}|{b}" for a, b in PLATFORM_CONTRACTS))


def gateway_candidates(uri: Column, gateways: tuple[str, ...] = ("https://ipfs.io/ipfs/", "https://dweb.link/ipfs/", "https://cloudflare-ipfs.com/ipfs/")) -> Column:
    """URLs under which content of a normalised URI can be found: one for each gateway, or the URI itself."""
    own = F.regexp_extract(uri, r"^ipfs:(.*)$", 1)
    return F.when(own != "", F.transform(F.array(*map(F.lit, gateways)), lambda g: F.concat(g, own))).otherwise(F.array(uri))


def clipped(c: Column, width: int) -> Column:
    """Without NUL characters, at most ``width`` characters."""
    return F.substring(F.translate(c, "\x00", ""), 1, width)
