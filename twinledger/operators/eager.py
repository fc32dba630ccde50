"""Eager aggregation through a join: aggregates move below the join, so that a hot key never multiplies rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.runtime import land

#: Of the compact states, a join key is hot from this share on; there are at most its reciprocal many such keys.
HOT_SHARE = 1 / 64


def _states(df: DataFrame, on: Sequence[str], keys: Sequence[str], sums: Sequence[str], side: str) -> DataFrame:
    """One row per (on, keys): how many rows it stands for and the sums of its measures. Null join keys never match and are left out."""
    for k in on:
        df = df.filter(F.col(k).isNotNull())
    return df.groupBy(*on, *keys).agg(F.count(F.lit(1)).alias(f"__n_{side}"), *(F.sum(c).alias(f"__{side}_{c}") for c in sums))


def eager_join_rollup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_keys: Sequence[str] = (),
    right_keys: Sequence[str] = (),
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    count_name: str = "n",
    salts: int = 16,
) -> DataFrame:
    """What ``left.join(right, on).groupBy(left_keys + right_keys).agg(count, sums)`` gives, without building the joined rows.

    Both inputs are aggregated by join key and own keys first (partial sums on the map side, so a hot key costs each task one row);
    the states are joined, counts multiplied, sums of one side multiplied by the count of the other, and the result is rolled up.
    A key that still holds more than HOT_SHARE of the left states is salted: its left states spread over ``salts`` tasks by their
    keys, its right states are repeated for each.

    Keys of left_keys and right_keys may be join keys; names must not repeat between the two lists, and columns named in neither list
    nor in ``on`` are dropped, so clashing names don't matter. Nulls: a null join key joins nothing; null is a group of its own among
    the other keys; null measures add nothing, and a group of only null measures sums to null. Empty inputs give no rows.
    """
    lk, rk = [c for c in left_keys if c not in on], [c for c in right_keys if c not in on]
    a, b = _states(left, on, lk, left_sums, "l"), _states(right, on, rk, right_sums, "r")
    if lk and salts > 1:
        a = land(a, "states")  # looked at twice: for hot keys, and to join
        per_key = a.groupBy(*on).agg(F.count(F.lit(1)).alias("__states"))
        total = per_key.agg(F.coalesce(F.sum("__states"), F.lit(0)).alias("__total")).scalar()
        hot = per_key.filter(F.col("__states") > F.greatest(F.lit(10_000), total * HOT_SHARE)).select(*on, F.lit(salts).alias("__salts"))
        a = a.join(F.broadcast(hot), list(on), "left").withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*lk), F.lit(salts)))).drop("__salts")
        b = b.join(F.broadcast(hot), list(on), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts").withColumn("__salt", F.col("__salt").cast("long"))
        a = a.withColumn("__salt", F.col("__salt").cast("long"))
        joined = a.join(b, [*on, "__salt"])
    else:
        joined = a.join(b, list(on))
    keys = list(dict.fromkeys([*left_keys, *right_keys]))
    return joined.groupBy(*keys).agg(
        F.sum(F.col("__n_l") * F.col("__n_r")).alias(count_name),
        *(F.sum(F.col(f"__l_{c}") * F.col("__n_r")).alias(f"sum_{c}") for c in left_sums),
        *(F.sum(F.col(f"__r_{c}") * F.col("__n_l")).alias(f"sum_{c}") for c in right_sums),
    )


def mode_per_key(counts: DataFrame, keys: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """Of counted values, the most frequent of each key; at a tie the smaller in byte order.

    A minimum over (count descending, value) is associative, so every task sends one row per key and no key's rows meet in one task.
    Null values don't compete; a key with none is left out.
    """
    best = F.min(F.struct((-F.col(count)).alias("c"), F.col(value).alias("v")))
    return counts.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("__best")).select(*keys, F.col("__best.v").alias(value))
