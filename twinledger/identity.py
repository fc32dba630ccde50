"""Contract identity: which raw (chain, address) spellings are the same contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: the chain whose addresses and token ids are case-sensitive
CASE_SENSITIVE_CHAIN = "solana"


def tidy_chain(chain: Column) -> Column:
    """Chain trimmed and lower-cased; null stays null."""
    return F.lower(F.trim(chain))


def tidy_address(chain: Column, address: Column) -> Column:
    """Address trimmed, lower-cased unless the chain is case-sensitive; null or blank gives null."""
    kept = F.trim(address)
    return F.when(kept == "", None).when(tidy_chain(chain) == CASE_SENSITIVE_CHAIN, kept).otherwise(F.lower(kept))


def is_blank(text: Column) -> Column:
    """True for null and for texts of spaces only."""
    return text.isNull() | (F.trim(text) == "")
