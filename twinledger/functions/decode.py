"""Binary forms of token events and token metadata accounts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.functions.text import base58_encode

# The first topics of the three transfer events (Keccak-256 of their signatures) and their standards.
TRANSFER = "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TRANSFER_SINGLE = "c3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62"
TRANSFER_BATCH = "4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb"


def _words(data: str) -> bytes:
    return bytes.fromhex(data[2:] if data[:2].lower() == "0x" else data)


def tokens_of_log(topics: list[str], data: str | None) -> list[tuple[str, str]]:
    """(token id, standard) of an event's topics and data in hexadecimal; nothing for other events and malformed data.

    A batch's ids lie in an array whose place its first word gives; a cut-off array gives the ids that are whole.
    """
    try:
        if topics is None or len(topics) != 4:
            return []
        kind = topics[0].lower().removeprefix("0x")
        if kind == TRANSFER:
            return [(str(int(topics[3], 16)), "ERC-721")]
        raw = _words(data or "")
        word = lambda at: int.from_bytes(raw[at : at + 32], "big")
        if kind == TRANSFER_SINGLE and len(raw) >= 32:
            return [(str(word(0)), "ERC-1155")]
        if kind == TRANSFER_BATCH and len(raw) >= 64 and (at := word(0)) + 32 <= len(raw):
            whole = min(word(at), (len(raw) - at - 32) // 32)
            return [(str(word(at + 32 * (i + 1))), "ERC-1155") for i in range(whole)]
    except (ValueError, TypeError, AttributeError):
        pass
    return []


def log_tokens(logs: DataFrame) -> DataFrame:
    """(contract_address, token_id, token_standard, block_number) of event logs (address, topics, data, block_number), distinct."""

    @F.pandas_udf("array<struct<token_id:string,token_standard:string>>")
    def decoded(topics: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([[{"token_id": t, "token_standard": s} for t, s in tokens_of_log(None if x is None else list(x), d)] for x, d in zip(topics, data)], dtype=object)

    each = logs.select(F.lower(F.trim("address")).alias("contract_address"), F.explode(decoded(F.col("topics"), F.col("data"))).alias("t"), "block_number")
    return each.groupBy("contract_address", "t.token_id", "t.token_standard").agg(F.min("block_number").alias("block_number"))


def metadata_account(data: bytes | None) -> dict | None:
    """The mint, name, symbol, URI and collection of a metadata account (version 1) in Borsh form; None if it is none.

    Texts have a length of four bytes before them. After the fee of two bytes come, each with a byte that says whether it is there: the
    creators (a count and 34 bytes each), then two flags, the edition nonce and token standard (one byte each), and the collection.
    """
    if not data or len(data) < 70 or data[0] != 4:
        return None
    at = 65

    def text() -> str:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "little") if at + 4 <= len(data) else 0
        raw, at = data[at + 4 : at + 4 + n], at + 4 + n
        return raw.decode("utf-8", "replace").rstrip("\0").strip()

    found = {"mint": base58_encode(data[33:65]), "name": text(), "symbol": text(), "uri": text(), "collection": None}
    at += 2
    if at < len(data):
        given, at = data[at], at + 1
        if given and at + 4 <= len(data):
            at += 4 + 34 * int.from_bytes(data[at : at + 4], "little")
        at += 2
        for _ in ("edition nonce", "token standard"):
            if at < len(data):
                at += 2 if data[at] else 1
        if at + 34 <= len(data) and data[at]:
            found["collection"] = base58_encode(data[at + 2 : at + 34])
    return found


def metadata_accounts(data: Column) -> Column:
    """metadata_account over a binary column; null for what is no metadata account."""

    @F.pandas_udf("mint string, name string, symbol string, uri string, collection string, valid boolean")
    def of(values: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("mint", "name", "symbol", "uri", "collection"))
        found = [metadata_account(v) for v in values]
        return pd.DataFrame([(f or none) | {"valid": f is not None} for f in found], columns=[*none, "valid"])

    s = of(data)
    return F.when(s["valid"], s.dropFields("valid"))
