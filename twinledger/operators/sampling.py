"""Repeatable samples by hash priority."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinledger.functions.permutations import permuted
from twinledger.operators.ranking import with_rank
from twinledger.runtime import land


def priority(seed: str, *key: Column) -> Column:
    """A pseudorandom text that orders rows the same way in any run: SHA-256 of the seed and the key."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *key), 256)


def sample_per_scope(rows: DataFrame, scope: Sequence[str], key: Sequence[str], size: int, seed: str = "0") -> DataFrame:
    """The ``size`` rows of lowest priority of each scope, with their rank from 1; all where a scope has fewer.

    Each task first keeps the ``size`` best of its own rows per scope (the window group limit that Spark plans below the shuffle), so
    a scope with a third of all rows sends size rows per task. The key must tell rows of a scope apart; repeated rows are one row.
    """
    ranked = rows.dropDuplicates([*scope, *key]).withColumn("__p", priority(seed, *(F.col(c).cast("string") for c in key)))
    window = Window.partitionBy(*scope).orderBy("__p", *key)
    return ranked.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= size).drop("__p")


def pair_scopes(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the chains of their ends, once for each scope of a sample: all, intra (one chain), pair (of two chains, in order) and cross (each chain of a pair of two)."""
    same = F.col(a) == F.col(b)
    lo, hi = F.least(a, b), F.greatest(a, b)
    scope = lambda kind, x=None, y=None: F.struct(F.lit(kind).alias("scope"), (F.lit(None) if x is None else x).cast("string").alias("chain"), (F.lit(None) if y is None else y).cast("string").alias("other"))
    kinds = F.when(same, F.array(scope("all"), scope("intra", F.col(a)))).otherwise(F.array(scope("all"), scope("pair", lo, hi), scope("cross", F.col(a)), scope("cross", F.col(b))))
    return pairs.filter(same.isNotNull()).withColumn("__s", F.explode(kinds)).select("*", "__s.*").drop("__s")


def sample_group_pairs(members: DataFrame, group: str, member: str, size: int, seed: int = 0) -> DataFrame:
    """(group, a, b): ``size`` different pairs of members of each group, all if it has fewer; its n (n - 1) / 2 pairs are never made.

    Members get ranks that no task has to hold a group for (see ranking.with_rank). A pseudorandom permutation of the numbers of a group's
    pairs gives the first ``size`` of them, each number is turned into two ranks, and these are joined with the members. Null groups and
    members are left out, repeated members count once.
    """
    given = members.select(F.col(group).alias("__g"), F.col(member).alias("__m")).filter("__g is not null and __m is not null").distinct()
    ranked = land(with_rank(given, ["__g"], [F.xxhash64(F.lit(seed), "__m"), F.col("__m")]), "ranked")
    groups = ranked.filter("rank = 1 and rank_of > 1").select("__g", F.col("rank_of").cast("long").alias("n")).withColumn("key", F.xxhash64(F.lit(seed), F.col("__g")))
    wanted = groups.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(size).cast("long"), F.expr("n * (n - 1) div 2")) - 1)))

    @F.pandas_udf("x long, y long")
    def ranks(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.DataFrame:
        n = n.to_numpy()
        at = permuted(i.to_numpy(), n * (n - 1) // 2, key.to_numpy().view(np.uint64))
        # pairs (x, y) with x > y, numbered x (x - 1) / 2 + y from 0; the root is put right where it is off by rounding
        x = ((1 + np.sqrt(1 + 8 * at.astype(float))) / 2).astype(np.int64)
        x = np.where(x * (x - 1) // 2 > at, x - 1, x)
        x = np.where((x + 1) * x // 2 <= at, x + 1, x)
        return pd.DataFrame({"x": x + 1, "y": at - x * (x - 1) // 2 + 1})

    chosen = land(wanted.withColumn("r", ranks("i", "n", "key")).select("__g", "r.x", "r.y"), "chosen")
    side = lambda r, name: ranked.select("__g", F.col("rank").cast("long").alias(r), F.col("__m").alias(name))
    both = chosen.join(side("x", "p"), ["__g", "x"]).join(side("y", "q"), ["__g", "y"])
    return both.select(F.col("__g").alias(group), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def balanced_targets(available: dict, total: int, seed: str = "0") -> dict:
    """How many to draw from each bucket: equal parts of the total, the rest one each to buckets by hash priority, and what a small bucket lacks spread over the others the same way."""
    left, out = dict(available), dict.fromkeys(available, 0)
    while total and (open_ := [k for k, n in left.items() if n]):
        part, rest = divmod(total, len(open_))
        extra = sorted(open_, key=lambda k: hashlib.sha256(f"{seed}|{k}".encode()).hexdigest())[:rest]
        for k in open_:
            take = min(left[k], part + (k in extra))
            out[k], left[k], total = out[k] + take, left[k] - take, total - take
    return out


def sample_pairs_with_pictures(pairs: DataFrame, tokens: DataFrame, size: int, seed: str = "0") -> DataFrame:
    """Matched contract pairs (chain_a, contract_a, chain_b, contract_b, score) of which both sides have a picture: ``size`` of one chain and ``size`` of two chains,
    with image_a and image_b, the picture of each contract's smallest token id that has one, pool (intra or cross) and rank.

    Within a pool every chain, or pair of chains, gives as even a part as it can (see balanced_targets; there are as many buckets as chains
    squared), by hash priority. The counts are taken first, so that only rows up to a bucket's target leave a task.
    """
    pictured = tokens.filter("image_uri_norm <> ''").groupBy("chain", "contract_address").agg(F.min(F.struct("token_id", "image_uri_norm")).alias("p"))
    side = lambda x: pictured.select(F.col("chain").alias(f"chain_{x}"), F.col("contract_address").alias(f"contract_{x}"), F.col("p.image_uri_norm").alias(f"image_{x}"))
    both = pairs.join(side("a"), ["chain_a", "contract_a"]).join(side("b"), ["chain_b", "contract_b"]).dropDuplicates(["chain_a", "contract_a", "chain_b", "contract_b"])
    both = land(both.withColumn("pool", F.when(F.col("chain_a") == F.col("chain_b"), "intra").otherwise("cross")), "pictured")
    counts = both.groupBy("pool", "chain_a", "chain_b").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per pair of chains
    targets = []
    for pool in ("intra", "cross"):
        of = {(r.chain_a, r.chain_b): r.n for r in counts if r.pool == pool}
        targets += [(*k, n) for k, n in balanced_targets(of, size, seed).items()]
    wanted = pairs.sparkSession.createDataFrame(targets, "chain_a string, chain_b string, target int")
    ranked = sample_per_scope(both, ["chain_a", "chain_b"], ["contract_a", "contract_b"], max((t for *_, t in targets), default=0), seed)
    return ranked.join(F.broadcast(wanted), ["chain_a", "chain_b"]).filter("rank <= target").drop("target")
