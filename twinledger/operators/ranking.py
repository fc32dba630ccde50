"""Exact ranks within keys of any size, and what follows from ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinledger.runtime import land


def with_rank(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Rows with their row number within their key, from 1, and ``<name>_of``, the rows of the key.

    Rows are range-partitioned by key and order, so one key may fill many partitions; each partition counts its keys, and a row's number
    is its number in its partition plus the counts before. No task holds a whole key. Rows that tie in the order get numbers in
    either way, so the order should be total. Null keys are a key of their own.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = land(rows.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = spread.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn(f"{name}_of", F.sum("__n").over(whole)).drop("__n")
    numbered = spread.withColumn("__at", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)))
    joined = numbered.alias("x").join(offsets.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys] + [F.col("x.__part") == F.col("y.__part")])
    return joined.select(*(F.col(f"x.{c}") for c in rows.columns), (F.col("__at") + F.col("__before")).alias(name), F.col(f"{name}_of"))


def gini(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, members, gini): the Gini coefficient of non-negative values per key; 0 where all are 0. Null values are left out."""
    ranked = with_rank(values.filter(F.col(value).isNotNull()), keys, [F.col(value)])
    weighted = (2 * F.col("rank") - F.col("rank_of") - 1) * F.col(value)
    sums = ranked.groupBy(*keys).agg(F.max("rank_of").alias("members"), F.sum(weighted).alias("w"), F.sum(value).alias("s"))
    return sums.select(*keys, "members", F.when(F.col("s") > 0, F.col("w") / (F.col("members") * F.col("s"))).otherwise(0.0).alias("gini"))


def top_share(values: DataFrame, keys: Sequence[str], value: str, tie: str, fraction: float = 0.1) -> DataFrame:
    """(keys, members, top_members, share): the part of a key's sum that its highest ceil(fraction * members) values hold; null if the sum is 0."""
    ranked = with_rank(values.filter(F.col(value).isNotNull()), keys, [F.col(value).desc(), F.col(tie)])
    top = F.ceil(F.col("rank_of") * fraction)
    sums = ranked.groupBy(*keys).agg(F.max("rank_of").alias("members"), F.max(top).alias("top_members"), F.sum(F.when(F.col("rank") <= top, F.col(value))).alias("t"), F.sum(value).alias("s"))
    return sums.select(*keys, "members", "top_members", F.when(F.col("s") > 0, F.col("t") / F.col("s")).alias("share"))
