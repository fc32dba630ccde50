"""Joins that hold when a few keys have most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.runtime import land

#: a key with more than this share of the rows is hot; there are at most its reciprocal many
HOT_SHARE = 1 / 1000
#: and it has at least so many rows
LEAST_HOT = 10_000


def hot_keys(rows: DataFrame, on: Sequence[str], share: float = HOT_SHARE, least: int = LEAST_HOT) -> DataFrame | None:
    """(on, parts) of the keys that more than ``share`` of the rows have, ``least`` rows at least: at most 1 / share rows, whatever the input.

    parts: among how many tasks the rows of a key should be spread so that each has no more than those limits. None if no key is hot. rows should be a
    landed table or a scan, as it is counted. Null keys are never hot, as they join nothing.
    """
    total = rows.count()
    if total <= least:
        return None
    limit = max(least, int(total * share))
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    for c in on:
        counts = counts.filter(F.col(c).isNotNull())
    found = land(counts.select(*on, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")), "hot")
    return None if found.isEmpty() else found


def spread_join(rows: DataFrame, other: DataFrame, on: Sequence[str], hot: DataFrame | None, by: Sequence[str | Column], how: str = "inner") -> DataFrame:
    """rows.join(other, on, how), inner or left, with the rows of hot keys (see hot_keys) spread by a hash of ``by`` over their parts.

    The other side's rows of a hot key are repeated for each part, all other rows join by their key as usual; so no task gets a hot key
    whole, and what is broadcast is the list of hot keys, whose length has a bound. ``by`` should tell the rows of a key apart.
    """
    if hot is None:
        return rows.join(other, list(on), how)
    few = F.broadcast(hot)
    # the part's number stays a long on both sides
    left = rows.join(few, list(on), "left").withColumn("__part", F.when(F.col("__parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*by), F.col("__parts").cast("long")))).drop("__parts")
    right = other.join(few, list(on), "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__parts"), F.lit(1)).cast("long") - 1))).drop("__parts")
    return left.join(right, [*on, "__part"], how).drop("__part")
