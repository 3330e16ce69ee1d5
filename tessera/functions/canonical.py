"""Canonical form of metadata JSON, as an Arrow UDF: strings and keys in compatibility form, lower case, single blanks; keys sorted;
attributes sorted by trait type and value; numbers without needless digits. Repeated keys make a document invalid (null)."""

from __future__ import annotations

import json
import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANKS = re.compile(r"\s+")


class Invalid(ValueError):
    pass


def _text(s: str) -> str:
    return BLANKS.sub(" ", unicodedata.normalize("NFKC", s).lower()).strip()


def _pairs(items: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in items:
        if k in out:
            raise Invalid(k)
        out[k] = v
    return out


def _refuse(name: str) -> None:
    raise Invalid(name)


def _number(d: Decimal) -> str:
    """Plain digits while they are short, else scientific form."""
    sign, digits, exponent = d.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    if not text:
        return "0"
    short = text.rstrip("0")
    power = exponent + len(text) - len(short)
    point = len(short) + power
    if 0 <= power <= 64:
        out = short + "0" * power
    elif 0 < point < len(short):
        out = f"{short[:point]}.{short[point:]}"
    elif -64 <= point <= 0:
        out = "0." + "0" * -point + short
    else:
        out = short[0] + ("." + short[1:] if len(short) > 1 else "") + (f"e{point - 1}" if point != 1 else "")
    return ("-" if sign else "") + out


def _write(value: object) -> str:
    if isinstance(value, str):
        return json.dumps(_text(value), ensure_ascii=False)
    if isinstance(value, dict):
        items: dict[str, object] = {}
        for k, v in value.items():
            key = _text(k)
            if key in items:
                raise Invalid(key)
            items[key] = v
        out = []
        for key in sorted(items):
            v = items[key]
            if key == "attributes" and isinstance(v, list):
                out.append(f"{json.dumps(key)}:[{','.join(_attributes(v))}]")
            else:
                out.append(f"{json.dumps(key, ensure_ascii=False)}:{_write(v)}")
        return "{" + ",".join(out) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    if isinstance(value, Decimal):
        return _number(value)
    return json.dumps(value)


def _attributes(items: list) -> list[str]:
    keyed = []
    for x in items:
        own = _write(x)
        if isinstance(x, dict):
            plain = {_text(k): v for k, v in x.items()}
            trait = plain.get("trait_type")
            keyed.append((_text(trait) if isinstance(trait, str) else "", _write(plain["value"]) if "value" in plain else "", own))
        else:
            keyed.append(("", own, own))
    # equal keys keep their order
    return [own for _, _, own in sorted(keyed, key=lambda k: k[:2])]


def canonical(raw: str | None) -> str | None:
    """The canonical form, or null for what is no object or array of valid JSON."""
    if raw is None or raw.strip()[:1] not in ("{", "["):
        return None
    try:
        return _write(json.loads(raw, object_pairs_hook=_pairs, parse_float=Decimal, parse_constant=_refuse))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    return raw.map(canonical, na_action="ignore")


def json_tokens(c: Column) -> Column:
    """Runs of letters and numbers."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
