"""Scopes of duplication: within a chain, from a chain to another, and across chains; their counts and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["kind", "primary_chain", "secondary_chain", "dimension", "duplicate_contract_count", "duplicate_nft_count"]


def scope_counts(hits: DataFrame, dimension: str) -> DataFrame:
    """COUNTS of hits (kind, primary_chain, secondary_chain, contract_address, n): distinct contracts and the sum of n.

    Contracts are grouped before they are counted, so a distinct count needs no sets.
    """
    keys = ["kind", "primary_chain", "secondary_chain"]
    per_contract = hits.groupBy(*keys, "contract_address").agg(F.sum("n").alias("n"))
    counted = per_contract.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_contract_count"), F.sum("n").alias("duplicate_nft_count"))
    return counted.withColumn("dimension", F.lit(dimension)).select(*COUNTS)


def member_counts(members: DataFrame, pairs: DataFrame | None, dimension: str) -> DataFrame:
    """Scope counts of members (name, chain, contract_address, members, n) whose name others bear, exactly or by the given pairs (a, b) of names.

    A member hits its own chain if its name has two members there, or a similar name has one; another chain if one of these names has
    a member on it. Contracts count once per scope with their n; counting goes over (name, chain) states, never over pairs of members.
    What a name is, is up to the caller: a text, or the key of a profile of documents.
    """
    states = members.groupBy("name", "chain").agg(F.sum("members").alias("m"))
    others = states.join(states.select("name", F.col("chain").alias("peer")), "name").filter("chain <> peer")
    linked = states.filter("m > 1").select("name", "chain", F.col("chain").alias("peer")).unionByName(others.select("name", "chain", "peer"))
    if pairs is not None:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        reached = both.join(states.select(F.col("name").alias("b"), F.col("chain").alias("peer")), "b").select(F.col("a").alias("name"), "peer").distinct()
        linked = linked.unionByName(states.select("name", "chain").join(reached, "name").select("name", "chain", "peer"))
    return _linked_counts(members, linked.distinct(), dimension)


def all_match_counts(members: DataFrame, dimension: str) -> DataFrame:
    """member_counts where every pair of names matches, as at a threshold of 0 or less: a member hits each chain that has another member."""
    chains = members.groupBy("chain").agg(F.sum("members").alias("m"))  # a row per chain
    peers = chains.select("chain", "m").join(F.broadcast(chains.select(F.col("chain").alias("peer"))), (F.col("chain") != F.col("peer")) | (F.col("m") > 1)).select("chain", "peer")
    return _linked_counts(members, members.select("name", "chain").distinct().join(F.broadcast(peers), "chain").select("name", "chain", "peer"), dimension)


def _linked_counts(members: DataFrame, linked: DataFrame, dimension: str) -> DataFrame:
    null = F.lit(None).cast("string")
    inner = F.col("chain") == F.col("peer")
    hits = members.join(linked, ["name", "chain"])
    # per contract, name and scope the tokens count once: cross is the union over peers
    own = hits.filter(inner).select(F.lit("intra").alias("kind"), F.col("chain").alias("primary_chain"), null.alias("secondary_chain"), "contract_address", "name", "n")
    matrix = hits.filter(~inner).select(F.lit("matrix").alias("kind"), F.col("chain").alias("primary_chain"), F.col("peer").alias("secondary_chain"), "contract_address", "name", "n")
    cross = matrix.withColumn("kind", F.lit("cross")).withColumn("secondary_chain", null).distinct()
    return scope_counts(own.unionByName(matrix).unionByName(cross), dimension)


def with_ratios(counts: DataFrame, totals: DataFrame, zero: float | None = 0.0) -> DataFrame:
    """Counts with contract_ratio and nft_ratio over the totals of the primary chain; ``zero`` where a total is 0 or missing."""
    joined = counts.join(F.broadcast(totals.withColumnRenamed("chain", "primary_chain")), "primary_chain", "left")

    def ratio(n: str, total: str):
        return F.when(F.col(total) > 0, F.col(n) / F.col(total)).otherwise(F.lit(zero).cast("double"))

    return joined.select(*COUNTS, ratio("duplicate_contract_count", "contracts").alias("contract_ratio"), ratio("duplicate_nft_count", "nfts").alias("nft_ratio"))


def duplicate_pairs_in_scope(relations: DataFrame) -> DataFrame:
    """Relations (seed_chain, candidate_chain, ...) once for each scope they lie in: all, intra or cross, intra_chain, cross_primary, matrix."""
    same = F.col("seed_chain") == F.col("candidate_chain")
    scope = lambda kind, p=None, s=None: F.struct(F.lit(kind).alias("scope"), (p if p is not None else F.lit(None)).cast("string").alias("primary_chain"), (s if s is not None else F.lit(None)).cast("string").alias("secondary_chain"))
    inner = F.array(scope("all"), scope("intra"), scope("intra_chain", F.col("seed_chain")))
    outer = F.array(scope("all"), scope("cross"), scope("cross_primary", F.col("seed_chain")), scope("matrix", F.col("seed_chain"), F.col("candidate_chain")))
    return relations.filter(same.isNotNull()).withColumn("__s", F.explode(F.when(same, inner).otherwise(outer))).select("*", "__s.*").drop("__s")


def unified_relations(relations: DataFrame) -> DataFrame:
    """(seed_chain, seed_address, candidate_chain, candidate_address, dimensions, nfts, reports): repeated relations as one.

    dimensions: the sorted union; nfts: how many different NFT ids all reports name. Ends are tidied; relations with a missing end and
    those of a contract with itself are dropped. Ids are exploded and made distinct before they are counted, so no set is held.
    """
    from twinledger.identity import tidy_address, tidy_chain

    key = ["seed_chain", "seed_address", "candidate_chain", "candidate_address"]
    tidy = relations.withColumns({
        "seed_address": tidy_address(F.col("seed_chain"), F.col("seed_address")), "candidate_address": tidy_address(F.col("candidate_chain"), F.col("candidate_address")),
        "seed_chain": tidy_chain(F.col("seed_chain")), "candidate_chain": tidy_chain(F.col("candidate_chain")),
    })
    given = tidy.filter("seed_chain is not null and seed_address is not null and candidate_chain is not null and candidate_address is not null")
    other = given.filter("seed_chain <> candidate_chain or seed_address <> candidate_address")
    named = other.select(*key, F.explode_outer("dimensions").alias("d")).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("d")), ",").alias("dimensions"))
    ids = other.select(*key, F.explode("nft_ids").alias("i")).distinct().groupBy(*key).agg(F.count("i").alias("nfts"))
    reports = other.groupBy(*key).agg(F.count(F.lit(1)).alias("reports"))
    return reports.join(named, key).join(ids, key, "left").select(*key, "dimensions", F.coalesce("nfts", F.lit(0)).alias("nfts"), "reports")


def relation_counts(relations: DataFrame) -> DataFrame:
    """(scope, primary_chain, secondary_chain, seeds, candidates, relations) of unified relations in each scope they lie in."""
    scoped = duplicate_pairs_in_scope(relations)
    keys = ["scope", "primary_chain", "secondary_chain"]
    end = lambda c: scoped.select(*keys, f"{c}_chain", f"{c}_address").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{c}s"))
    out = scoped.groupBy(*keys).agg(F.count(F.lit(1)).alias("relations"))
    for c in ("seed", "candidate"):
        own = end(c).alias("y")
        out = out.alias("x").join(own, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]).select("x.*", f"y.{c}s")
    return out


def edge_scope(a: str, b: str) -> Column:
    """The scopes of an edge from chain a to chain b, as an array: total, and intra, or cross and matrix with the other chain."""
    scope = lambda kind, x=None: F.struct(F.lit(kind).alias("scope"), (F.lit(None) if x is None else x).cast("string").alias("secondary_chain"))
    return F.when(F.col(a) == F.col(b), F.array(scope("total"), scope("intra"))).otherwise(F.array(scope("total"), scope("cross"), scope("matrix", F.col(b))))


def scale_with_denominators(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """relation_counts with the contracts that there are (totals: chain, contracts) where the candidates lie, and the share of them that is reached.

    Candidates of matrix lie on the second chain, those of intra_chain on the first; other scopes take in all chains. Null without contracts.
    """
    own = F.coalesce(F.when(F.col("scope") == "intra_chain", F.col("primary_chain")), F.when(F.col("scope") == "matrix", F.col("secondary_chain")))
    every = totals.agg(F.sum("contracts").alias("__all"))
    joined = counts.withColumn("__c", own).join(F.broadcast(totals.select(F.col("chain").alias("__c"), F.col("contracts").alias("__own"))), "__c", "left").join(F.broadcast(every))
    n = F.when(F.col("__c").isNull(), F.col("__all")).otherwise(F.col("__own"))
    return joined.withColumn("contracts", n).withColumn("candidate_share", F.when(F.col("contracts") > 0, F.col("candidates") / F.col("contracts"))).select(*counts.columns, "contracts", "candidate_share")
