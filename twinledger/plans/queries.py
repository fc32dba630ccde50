"""Queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.operators import representative, shred
from twinledger.operators.eager import eager_join_rollup
from twinledger.identity import tidy_address, tidy_chain
from twinledger.runtime import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = shred.shred(table(spark, d, "nft_assets", "asset_id", "metadata"), "asset_id", "metadata")
    return shred.array_objects(nodes, "asset_id")


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the attribute objects: one row each, linked to asset and parent."""
    found = shred.entities(shred.shred(table(spark, d, "nft_assets", "asset_id", "metadata"), "asset_id", "metadata"), "asset_id")
    return shred.entity_table(found.filter("in_array"), "asset_id", "attributes", ["trait_type", "value", "display_type"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return representative.representative_names(table(spark, d, "snapshot", "chain", "contract_address", "name_norm"))


def p7_activity(spark: SparkSession, d: str) -> DataFrame:
    """Joined rows of snapshot and transfers per contract, and the sums of both sides over them, without joining the rows."""
    def keyed(name: str, *more: str) -> DataFrame:
        rows = table(spark, d, name, "chain", "contract_address", *more)
        return rows.select(tidy_chain(F.col("chain")).alias("chain"), tidy_address(F.col("chain"), F.col("contract_address")).alias("contract_address"), *more)

    on = ["chain", "contract_address"]
    return eager_join_rollup(keyed("snapshot", "first_seen_block"), keyed("transfers", "block_number"), on, on, (), ["first_seen_block"], ["block_number"], "joined_rows")


QUERIES = {f.__name__: f for f in (p5_found, p5_attributes, p7_found, p7_activity)}


def _tidy(chain: str = "chain", address: str = "contract_address") -> str:
    return f"lower(trim({chain})) AS chain, CASE WHEN trim({address}) = '' THEN NULL WHEN lower(trim({chain})) = 'solana' THEN trim({address}) ELSE lower(trim({address})) END AS contract_address"


_TREE = """
j AS (SELECT asset_id, CAST(metadata AS JSON) m FROM nft_assets WHERE json_valid(metadata)),
u AS (SELECT asset_id, CASE WHEN json_type(m) = 'VARCHAR' THEN m ->> '$' ELSE CAST(m AS VARCHAR) END m FROM j),
t AS (SELECT u.asset_id, replace(x.fullkey, '"', '') p, x.type ty, x.value v FROM (SELECT * FROM u WHERE json_valid(m)) u, json_tree(u.m) x),
o AS (SELECT asset_id, p, regexp_replace(p, '(\\.[^.\\[]*)?(\\[[0-9]+\\])+$', '') parent, v FROM t WHERE ty = 'OBJECT' AND p LIKE '%]')"""

ORACLES = {
    "p5_found": f"WITH {_TREE} SELECT asset_id, parent parent_path, p node_path FROM o",
    "p5_attributes": f"""WITH {_TREE} SELECT asset_id, parent parent_path, p node_path, CAST(regexp_extract(p, '\\[([0-9]+)\\]$', 1) AS INT) ordinal, {", ".join(f"CASE WHEN json_type(v, '$.{c}') NOT IN ('OBJECT', 'ARRAY') THEN v ->> '$.{c}' END m_{c}" for c in ("trait_type", "value", "display_type"))}
        FROM o WHERE regexp_matches(p, '\\.attributes(\\[[0-9]+\\])+$')""",
    "p7_found": f"""WITH s AS (SELECT {_tidy()}, name_norm FROM snapshot WHERE trim(name_norm) <> ''),
        c AS (SELECT chain, contract_address, name_norm, count(*) n FROM s WHERE contract_address IS NOT NULL AND chain IS NOT NULL GROUP BY ALL)
        SELECT chain, contract_address, arg_min(name_norm, (-n, name_norm)) name_norm FROM c GROUP BY ALL""",
    "p7_activity": f"""WITH a AS (SELECT {_tidy()}, first_seen_block FROM snapshot), b AS (SELECT {_tidy()}, block_number FROM transfers)
        SELECT chain, contract_address, count(*) joined_rows, CAST(sum(first_seen_block) AS BIGINT) sum_first_seen_block, CAST(sum(block_number) AS BIGINT) sum_block_number
        FROM a JOIN b USING (chain, contract_address) GROUP BY ALL""",
}
