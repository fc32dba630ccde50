"""The representative name of each contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.identity import is_blank, tidy_address, tidy_chain
from twinledger.operators.eager import eager_join_rollup, mode_per_key


def identities(rows: DataFrame) -> DataFrame:
    """One row per raw spelling of a contract: raw_chain, raw_address and the tidied chain, contract_address."""
    raw = rows.select(F.col("chain").alias("raw_chain"), F.col("contract_address").alias("raw_address")).distinct()
    tidy = raw.select("raw_chain", "raw_address", tidy_chain(F.col("raw_chain")).alias("chain"), tidy_address(F.col("raw_chain"), F.col("raw_address")).alias("contract_address"))
    return tidy.filter(F.col("contract_address").isNotNull() & F.col("chain").isNotNull())


def name_counts(rows: DataFrame) -> DataFrame:
    """chain, contract_address, name_norm, n: how often a contract has a non-blank name, over all rows.

    The rows join their contract's identity; counting happens below that join, per raw spelling. Null or blank addresses are no
    contract, null chains neither; blank and null names don't count. Other columns are ignored; an empty table gives no rows.
    """
    named = rows.filter(~is_blank(F.col("name_norm"))).select(F.col("chain").alias("raw_chain"), F.col("contract_address").alias("raw_address"), "name_norm")
    return eager_join_rollup(named, identities(rows), ["raw_chain", "raw_address"], ["name_norm"], ["chain", "contract_address"])


def representative_names(rows: DataFrame) -> DataFrame:
    """chain, contract_address, name_norm: the most frequent name of each contract that has one; ties go to the smaller in byte order."""
    return mode_per_key(name_counts(rows), ["chain", "contract_address"], "name_norm").select("chain", "contract_address", "name_norm")
