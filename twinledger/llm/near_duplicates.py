"""Records of a snapshot that were copied with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.similar import Join, Similar, similar_sets
from twinledger.llm.terms import terms
from twinledger.runtime import land, landing_scope

METADATA_LEAST_TERMS, METADATA_THRESHOLD, METADATA_SHARED = 20, 0.7, 10
NAME_LEAST_CHARS, NAME_THRESHOLD, NAME_GRAM = 8, 0.5, 3


def metadata_sets(rows: DataFrame) -> DataFrame:
    """(id, tokens) of rows with enough distinct terms in metadata_json, taken as raw text."""
    hashed = F.array_distinct(F.transform(terms(F.col("metadata_json")), lambda term: F.xxhash64(term)))
    return rows.select(F.col("row_id").alias("id"), hashed.alias("tokens")).filter(F.size("tokens") >= METADATA_LEAST_TERMS)


def name_sets(rows: DataFrame) -> DataFrame:
    """(id, tokens) of names with enough characters: their substrings of NAME_GRAM characters."""
    grams = F.transform(F.sequence(F.lit(1), F.length("name_norm") - NAME_GRAM + 1), lambda i: F.xxhash64(F.substring(F.col("name_norm"), i, F.lit(NAME_GRAM))))
    return rows.filter(F.length("name_norm") >= NAME_LEAST_CHARS).select(F.col("row_id").alias("id"), F.array_distinct(grams).alias("tokens"))


def distinct_names(snapshot: DataFrame) -> DataFrame:
    """(row_id, name_norm): every different value exactly as stored, with the smallest row_id that has it; null is no value."""
    return snapshot.filter(F.col("name_norm").isNotNull()).groupBy("name_norm").agg(F.min("row_id").alias("row_id")).select("row_id", "name_norm")


def _similar(snapshot: DataFrame, make) -> Similar:
    """What make() finds, as two tables; all others that it wrote are deleted."""
    with landing_scope(snapshot.sparkSession):
        found = make()
        return Similar(land(found.pairs, "pairs", outer=True), land(found.members, "members", outer=True))


def similar_metadata(snapshot: DataFrame, threshold: float = METADATA_THRESHOLD) -> Similar:
    """Rows whose metadata terms are similar; rows with null or short metadata take no part, and equal term sets are one class."""
    return _similar(snapshot, lambda: similar_sets(snapshot.select("row_id", "metadata_json"), metadata_sets, Join(threshold, METADATA_SHARED)))


def similar_names(snapshot: DataFrame, threshold: float = NAME_THRESHOLD) -> Similar:
    """Names, each standing for its smallest row_id, that are similar in their substrings; short and null names take no part."""
    return _similar(snapshot, lambda: similar_sets(land(distinct_names(snapshot.select("row_id", "name_norm")), "names"), name_sets, Join(threshold)))
