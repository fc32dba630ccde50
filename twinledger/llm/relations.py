"""Groups of contracts that match results link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.identity import tidy_address, tidy_chain
from twinledger.llm.components import components


def relation_pairs(relations: DataFrame) -> DataFrame:
    """seed, candidate as ``chain:address``, where both ends are given."""
    def end(chain: str, address: str):
        return F.concat(tidy_chain(F.col(chain)), F.lit(":"), tidy_address(F.col(chain), F.col(address)))

    return relations.select(end("seed_chain", "seed_address").alias("seed"), end("candidate_chain", "candidate_address").alias("candidate")).filter("seed is not null and candidate is not null")


def contract_groups(relations: DataFrame) -> DataFrame:
    """chain, contract_address, group_key: the group of every contract that is an end of a relation with both ends given.

    group_key is the smallest ``chain:address`` of the group in byte order. A relation with a null chain or a null or blank address
    at either end is left out whole; self-relations count. An empty table gives no rows.
    """
    found = components(relation_pairs(relations), "seed", "candidate")
    return found.select(F.substring_index("v", ":", 1).alias("chain"), F.expr("substring(v, instr(v, ':') + 1)").alias("contract_address"), F.col("label").alias("group_key"))
