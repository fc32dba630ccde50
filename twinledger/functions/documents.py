"""Canonical forms of JSON metadata."""

from __future__ import annotations

import json
import unicodedata
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: longest accepted document in bytes, and the zeros up to which a number is written out
MOST_BYTES, MOST_ZEROS = 65_536, 64


class _Number(str):
    """A number as it is written."""


def _unique(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def _refuse(name: str) -> None:
    raise ValueError(name)


def strict_parse(text: str):
    """A document with its numbers as written; raises ValueError for repeated keys and what JSON doesn't know."""
    try:
        return json.loads(text, object_pairs_hook=_unique, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError("too deep") from e


def plain_text(text: str) -> str:
    """Compatibility forms resolved, lower case, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def plain_number(written: str) -> str:
    """A number in one form: no trailing zeros; written out where that takes at most MOST_ZEROS added zeros, else scientific."""
    try:
        sign, digits, exponent = Decimal(written).as_tuple()
    except InvalidOperation:
        return written
    text = "".join(map(str, digits)).lstrip("0")
    if not text:
        return "0"
    short = text.rstrip("0")
    exponent += len(text) - len(short)
    point = len(short) + exponent
    if 0 <= exponent <= MOST_ZEROS:
        body = short + "0" * exponent
    elif 0 < point < len(short):
        body = f"{short[:point]}.{short[point:]}"
    elif -MOST_ZEROS <= point <= 0:
        body = "0." + "0" * -point + short
    else:
        body = short[0] + (f".{short[1:]}" if short[1:] else "") + (f"e{point - 1}" if point != 1 else "")
    return "-" * sign + body


def _write(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def _plain(value):
    if isinstance(value, dict):
        inner = _unique([(plain_text(k), _plain(v)) for k, v in value.items()])
        if isinstance(inner.get("attributes"), list):
            inner["attributes"] = sorted(inner["attributes"], key=_attribute_order)
        return {k: inner[k] for k in sorted(inner)}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, _Number):
        return _Number(plain_number(value))
    return plain_text(value) if isinstance(value, str) else value


def _attribute_order(a) -> tuple[str, str]:
    if not isinstance(a, dict):
        return "", _write(a)
    kind = a.get("trait_type")
    return kind if isinstance(kind, str) and not isinstance(kind, _Number) else "", _write(a["value"]) if "value" in a else ""


def canonical(text: str | None, normalised: bool = True) -> str | None:
    """A metadata document in canonical form, or None if it is no valid one: blank, longer than MOST_BYTES, no object or array, not
    strict JSON, empty object, or with keys that become equal. normalised: texts and numbers too, and attributes in order; else only
    keys are sorted."""
    text = (text or "").strip()
    if not text or text[0] not in "{[" or len(text.encode("utf-8", "replace")) > MOST_BYTES:
        return None
    try:
        value = strict_parse(text)
        out = _write(_plain(value) if normalised else _sorted(value))
    except ValueError:
        return None
    return None if out == "{}" else out


def _sorted(value):
    if isinstance(value, dict):
        return {k: _sorted(value[k]) for k in sorted(value)}
    return [_sorted(v) for v in value] if isinstance(value, list) else value


def canonical_json(document: Column, normalised: bool = True) -> Column:
    """canonical() over a column. No built-in keeps numbers exact and refuses repeated keys, so this is an Arrow function."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical(t, normalised))

    return of(document)
