"""Staging tables as DataFrames: insert if absent, fill in, remove, retry, and the best-ranked seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinledger.functions.text import fill_token_id, image_of, inline_json


def insert_absent(table: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The table and those rows of a batch whose key it lacks; of rows with one key the first in order. Keys with a null count as equal."""
    first = batch.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")
    condition = [table[k].eqNullSafe(first[k]) for k in key]
    return table.unionByName(first.join(table, condition, "left_anti").select(*table.columns))


def upsert(table: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per key the batch's values where they are not null, else the table's; both must have unique, non-null keys."""
    rest = [c for c in table.columns if c not in key]
    new = batch.select(*key, *(F.col(c).alias(f"__new_{c}") for c in rest))
    return table.join(new, list(key), "full_outer").select(*(F.col(c) if c in key else F.coalesce(f"__new_{c}", c).alias(c) for c in table.columns))


def remove_listed(table: DataFrame, listed: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table without the keys of a list."""
    return table.join(listed.select(*key).distinct(), list(key), "left_anti")


def storable(text: Column, most: int) -> Column:
    """Text without NUL signs, cut to a column's width."""
    return F.substring(F.regexp_replace(text, "\u0000", ""), 1, most)


def insert_assets(table: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str | Column], widths: dict[str, int]) -> DataFrame:
    """insert_absent of a batch whose texts are made storable: without NUL signs, and those of columns with a width cut to it."""
    plain = {f.name: storable(F.col(f.name), widths.get(f.name, 2**31 - 1)) for f in batch.schema.fields if f.dataType.typeName() == "string"}
    return insert_absent(table, batch.withColumns(plain), key, order)


def usable_assets(assets: DataFrame, bad_prefixes: Sequence[str] = ()) -> DataFrame:
    """Collected assets (chain, contract_address, token_id, token_uri, image_uri, ...) that are worth keeping, with what their URI tells filled in.

    A missing picture is taken from a document inside the token URI. Contracts of which any asset has its picture inside the URI itself
    (``data:image``) are left out whole, as they can't be told apart by URIs; so are assets without a token URI or with one that begins with one of
    bad_prefixes. ``{id}`` in a token URI becomes the token id.
    """
    key = ["chain", "contract_address"]
    shown = assets.withColumn("image_uri", F.coalesce("image_uri", image_of(inline_json(F.col("token_uri")))))
    inside = shown.filter(F.col("image_uri").startswith("data:image")).select(*key).distinct()
    given = shown.filter(F.coalesce(F.col("token_uri") != "", F.lit(False)))
    for p in bad_prefixes:
        given = given.filter(~F.col("token_uri").startswith(p))
    return given.join(inside, key, "left_anti").withColumn("token_uri", fill_token_id(F.col("token_uri"), F.col("token_id"))).select(*assets.columns)


def retry_queue(assets: DataFrame, limit: int) -> DataFrame:
    """(token_uri, checked_at): token URIs of assets that lack a picture, longest unchecked first, ties by URI."""
    lacking = assets.filter((F.trim(F.coalesce("image_uri", F.lit(""))) == "") & (F.trim(F.coalesce("token_uri", F.lit(""))) != ""))
    return lacking.groupBy("token_uri").agg(F.min("created_at").alias("checked_at")).orderBy(F.col("checked_at").asc_nulls_first(), "token_uri").limit(limit)


def top_seeds(seeds: DataFrame, most: int) -> DataFrame:
    """(chain, address, seed_rank, metric, metric_window, feed, position): per chain and ranking the first ``most`` different contracts.

    Of a contract that a ranking lists repeatedly the best rank counts; null ranks come last; ties go to the smaller address.
    """
    from twinledger.identity import tidy_address, tidy_chain

    keys = ["feed", "metric", "metric_window", "chain"]
    tidy = seeds.select("feed", "metric", "metric_window", tidy_chain(F.col("chain")).alias("chain"), tidy_address(F.col("chain"), F.col("address")).alias("address"), "seed_rank")
    best = tidy.filter(F.col("address").isNotNull()).groupBy(*keys, "address").agg(F.min("seed_rank").alias("seed_rank"))
    ranked = best.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seed_rank").asc_nulls_last(), "address")))
    return ranked.filter(F.col("position") <= most)
