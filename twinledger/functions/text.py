"""Scalar functions on URIs, names, token ids and addresses."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for "no URI" and "no name".
NO_URI = ["nano", "null", "none", "undefined", "n/a", "na", "-", ".", "false", "true", "0"]
NO_NAME = ["none", "null", "nil", "undefined", "n/a", "na", "n.a.", "nan", "-", "--", "."]

# What a numbered item carries at the end of its collection's name, tried in this order.
NUMBERED_ENDS = [
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
]
# Gateways that serve content-addressed files over HTTP.
IPFS_GATEWAY = r"(?i)^https?://[^/]+/ipfs/([A-Za-z0-9][^?#\s]*)"
ARWEAVE_GATEWAY = r"(?i)^https?://(?:[^/]+\.)?arweave\.net/([A-Za-z0-9_-]{43}(?:/[^?#\s]*)?)"
HTTP_GATEWAYS = {"ipfs": "https://ipfs.io/ipfs/", "ar": "https://arweave.net/"}
#: passes over the numbered ends
NAME_PASSES = 20


#: white space of any script
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _strip(x: Column) -> Column:
    """Without white space at the ends; a pattern for the end would go over long runs of it again and again."""
    return F.btrim(x, F.lit(SPACES))


def normalize_url(uri: Column) -> Column:
    """A URI as a key: content addresses as ``ipfs:`` or ``ar:`` and their path (case kept, no query, fragment or outer slashes), all
    others lower-cased without trailing slashes. Null, blank, null-like and data URIs give an empty string. Pure column expressions."""
    value = _strip(F.coalesce(uri, F.lit("")))
    low = F.lower(value)

    def addressed(path: Column, scheme: str) -> Column:
        kept = F.btrim(F.regexp_extract(path, r"^[^?#]*", 0), F.lit("/"))
        return F.when(kept != "", F.concat(F.lit(f"{scheme}:"), kept)).otherwise("")

    ipfs, arweave = F.regexp_extract(value, IPFS_GATEWAY, 1), F.regexp_extract(value, ARWEAVE_GATEWAY, 1)
    return (
        F.when((value == "") | low.isin(*NO_URI) | low.startswith("data:"), "")
        .when(low.startswith("ipfs://"), addressed(F.regexp_replace(F.substring(value, F.lit(8), F.length(value)), "(?i)^ipfs/", ""), "ipfs"))
        .when(low.startswith("ar://"), addressed(F.substring(value, F.lit(6), F.length(value)), "ar"))
        .when(ipfs != "", addressed(ipfs, "ipfs"))
        .when(arweave != "", addressed(arweave, "ar"))
        .otherwise(F.rtrim(low, F.lit("/")))
    )


def gateway_url(key: Column) -> Column:
    """A normalized content address as an HTTP URL of a public gateway; other URIs stay as they are."""
    out = key
    for scheme, base in HTTP_GATEWAYS.items():
        out = F.when(key.startswith(f"{scheme}:"), F.concat(F.lit(base), F.regexp_replace(key, f"^{scheme}:/*", ""))).otherwise(out)
    return out


def url_suffix(uri: Column) -> Column:
    """The file suffix of a URI's path, lower-cased; null if it has none."""
    found = F.lower(F.regexp_extract(F.regexp_extract(uri, r"^[^?#]*", 0), r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(found != "", found)


# Media types of pictures with their suffix, other spellings of suffixes, and how files of some types begin (in hexadecimal).
PICTURE_TYPES = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "image/avif": ".avif", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/x-icon": ".ico"}
SAME_SUFFIX = {".jpeg": ".jpg", ".tif": ".tiff"}
BEGINNINGS = {".png": "89504E470D0A1A0A", ".jpg": "FFD8FF", ".gif": "474946383[79]61", ".webp": "52494646.{8}57454250"}


def picture_suffix(media_type: Column, uri: Column, head: Column) -> Column:
    """The suffix of a picture file by its media type, else by its URI's path, else by its first bytes (head, binary); null if none tells.

    A text whose first 1,024 bytes hold ``<svg`` is one. Nulls tell nothing.
    """
    kind = F.trim(F.substring_index(media_type, ";", 1))
    by_type = F.coalesce(*(F.when(kind == t, s) for t, s in PICTURE_TYPES.items()))
    path = F.lower(F.regexp_extract(uri, r"^[^?#]*", 0))
    known = dict.fromkeys([*PICTURE_TYPES.values(), *SAME_SUFFIX])
    by_path = F.coalesce(*(F.when(path.endswith(s), SAME_SUFFIX.get(s, s)) for s in known))
    begins = F.hex(F.substring(head, 1, 16))
    by_head = F.coalesce(*(F.when(begins.rlike(f"^{p}"), s) for s, p in BEGINNINGS.items()), F.when(F.lower(F.decode(F.substring(head, 1, 1024), "ISO-8859-1")).contains("<svg"), ".svg"))
    return F.coalesce(by_type, by_path, by_head)


def name_without_number(raw: str | None) -> str | None:
    """A name without compatibility forms, numbered ends, spare white space and case."""
    if raw is None:
        return None
    value = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", raw)).strip()
    for _ in range(NAME_PASSES):
        shorter = next((v for v in (re.sub(p, "", value, count=1).strip() for p in NUMBERED_ENDS) if v != value), None)
        if shorter is None:
            break
        value = shorter
    return re.sub(r"\s+", " ", value).strip().lower()


def normalize_name(name: Column) -> Column:
    """name_without_number over a column; NFKC has no built-in function, so this is the one Arrow function here. Null stays null."""

    @F.pandas_udf("string")
    def of(names: pd.Series) -> pd.Series:
        known = {n: name_without_number(n) for n in names.dropna().unique()}
        return pd.Series([known.get(n) for n in names], dtype=object)

    return of(name)


def usable_name(name: Column) -> Column:
    """False for null, blank, null-like names and single digits."""
    value = _strip(F.coalesce(name, F.lit("")))
    return (value != "") & ~F.lower(value).isin(*NO_NAME) & ~value.rlike(r"^[0-9]$")


def token_order(token: Column) -> Column:
    """A struct that sorts token ids: decimal ones first, by magnitude whatever their length, others by their text."""
    decimal = token.rlike(r"^[0-9]+$")
    digits = F.regexp_replace(token, r"^0+(?=.)", "")
    return F.struct((~decimal).alias("other"), F.when(decimal, F.length(digits)).otherwise(0).alias("digits"), F.when(decimal, digits).otherwise(token).alias("text"))


def plain_decimal(token: Column) -> Column:
    """A decimal token id without leading zeros; others as they are."""
    return F.when(token.rlike(r"^[0-9]+$"), F.regexp_replace(token, r"^0+(?=.)", "")).otherwise(token)


def hex_to_decimal(text: Column) -> Column:
    """An unsigned hexadecimal number of any length, with or without 0x, as decimal text; null if it is none."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: str(int(v, 16)) if isinstance(v, str) and re.fullmatch(r"(0[xX])?[0-9a-fA-F]+", v) else None)

    return of(text)


def fill_token_id(uri: Column, token: Column) -> Column:
    """A URI with ``{id}`` replaced by the token id as 64 hexadecimal digits; unchanged where the id is not decimal."""

    @F.pandas_udf("string")
    def of(uris: pd.Series, tokens: pd.Series) -> pd.Series:
        def one(u, t):
            return u.replace("{id}", format(int(t), "064x")) if u and t and "{id}" in u and re.fullmatch("[0-9]+", t) else u

        return pd.Series([one(u, t) for u, t in zip(uris, tokens)], dtype=object)

    return of(uri, token)


def inline_json(uri: Column) -> Column:
    """The JSON text inside a ``data:application/json`` URI, base64 or percent-encoded; null for any other URI."""
    body = F.regexp_extract(uri, r"(?is)^data:application/[^,]*,(.*)$", 1)
    is_base64 = uri.rlike(r"(?i)^data:application/[^,]*;base64,")
    return F.when(uri.rlike(r"(?i)^data:application/"), F.when(is_base64, F.try_to_binary(body, F.lit("base64")).cast("string")).otherwise(F.try_url_decode(body)))


#: fixed values: members that may hold the picture, in order of preference
IMAGE_KEYS = ["image", "image_url", "imageUrl", "image_uri", "animation_url"]


def image_of(document: Column) -> Column:
    """The picture URL of a metadata document: the first of IMAGE_KEYS that holds text; null if none or if it is not JSON."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(document, f"$.{k}")), F.lit("")) for k in IMAGE_KEYS))


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58_decode(text: str) -> bytes | None:
    """The bytes of a base58 text; null if a sign is not of the alphabet."""
    n = 0
    for c in text:
        at = BASE58.find(c)
        if at < 0:
            return None
        n = n * 58 + at
    return b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def base58_encode(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def valid_address(chain: Column, address: Column) -> Column:
    """Whether an address has the form of its chain: 0x and 40 hexadecimal digits, or base58 of 32 bytes on solana."""

    @F.pandas_udf("boolean")
    def is_key(values: pd.Series) -> pd.Series:
        return values.map(lambda v: isinstance(v, str) and 32 <= len(v) <= 44 and len(base58_decode(v) or b"") == 32).astype(bool)

    return F.when(F.lower(F.trim(chain)) == "solana", is_key(F.trim(address))).otherwise(F.trim(address).rlike("^0[xX][0-9a-fA-F]{40}$"))


def abi_string(data: Column) -> Column:
    """The text in the ABI encoding (0x, hexadecimal) of one returned string; null if it is malformed."""

    def one(v):
        try:
            raw = bytes.fromhex(v[2:] if v[:2].lower() == "0x" else v)
            at = int.from_bytes(raw[:32], "big")
            n = int.from_bytes(raw[at : at + 32], "big")
            body = raw[at + 32 : at + 32 + n]
            return body.decode() if at + 32 + n <= len(raw) else None
        except (ValueError, TypeError, OverflowError):
            return None

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(one)

    return of(data)
