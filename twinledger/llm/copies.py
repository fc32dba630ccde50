"""Snapshot records that are the same but for formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.ledger import CopyLedger, copies_of, keyed, record_key
from twinledger.runtime import land, shared_path, spread

#: ledger rows that a bucket is to hold
BUCKET_ROWS = 2_000_000


def snapshot_ledger(snapshot: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(records, ledger): the keyed records of a snapshot and the ledger after its batches, one for each quarter of a year of ingested_at.

    Rows with a null ingested_at are a batch of their own. A record without a term in one of name_norm, token_uri_norm and
    image_uri_norm has no key and is in neither. Identical rows are copies as well. An empty table gives an empty ledger. The ledger has
    a bucket for each bucket_rows of the records.
    """
    spark = snapshot.sparkSession
    key = record_key(F.col("name_norm"), F.col("token_uri_norm"), F.col("image_uri_norm"))
    batch = F.concat_ws("q", F.year("ingested_at"), F.quarter("ingested_at"))
    wanted = spread(snapshot.select("row_id", "name_norm", "token_uri_norm", "image_uri_norm", "ingested_at")).withColumn("batch", F.when(F.col("ingested_at").isNull(), "none").otherwise(batch))
    records = land(keyed(wanted, key, "row_id"), "records", "batch")
    sizes = {r.batch: r.n for r in records.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per quarter
    ledger = CopyLedger(spark, shared_path(spark, "ledger"), -(-sum(sizes.values()) // bucket_rows))
    for name in sorted(sizes):
        ledger.take(records.filter(F.col("batch") == name).drop("batch"), name)
    return records.drop("batch"), ledger.rows()


def copy_pairs(snapshot: DataFrame) -> DataFrame:
    """row_id_a, row_id_b: the smallest id of a set of copies and each other one."""
    records, ledger = snapshot_ledger(snapshot)
    return copies_of(records, ledger).select(F.col("record").alias("row_id_a"), F.col("copy").alias("row_id_b"))


def collapsed(snapshot: DataFrame) -> DataFrame:
    """row_id, copies: one row for each set of copies, records without any included, and how many records it has."""
    return snapshot_ledger(snapshot)[1].select(F.col("record").alias("row_id"), "copies")
