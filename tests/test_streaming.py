from datetime import datetime

from pyspark.sql import functions as F

from twinledger.streaming import ingest

ROWS = "row_id long, chain string, contract_address string, token_id string, first_seen_block long, ingested_at timestamp_ntz"


def write(spark, folder, number, data):
    spark.createDataFrame(data, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/snapshot.parquet")


def row(i, token, day=1, chain="base"):
    return (i, chain, "0xA", token, i, datetime(2024, 1, day))


def test_grow_takes_each_key_once(spark, tmp_path):
    folder, base, key = str(tmp_path / "in"), str(tmp_path / "out"), ["chain", "contract_address", "token_id"]
    write(spark, folder, 1, [row(2, "a"), row(1, "a"), row(3, "b")])
    write(spark, folder, 2, [row(4, "a"), row(5, "c")])
    stream = lambda: ingest.token_keys(ingest.stream_table(spark, folder, "snapshot", files_per_batch=1))
    ingest.grow(stream(), base, key, ["row_id"])
    read = lambda: sorted(r.token_id for r in spark.read.schema(stream().schema).parquet(f"{base}/table").collect())
    assert read() == ["a", "b", "c"]
    write(spark, folder, 3, [row(6, "c"), row(7, "d", chain=" BASE ")])
    ingest.grow(stream(), base, key, ["row_id"])
    assert read() == ["a", "b", "c", "d"]


def test_daily_counts(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, 1, [row(1, "a"), row(2, "b", 2), row(3, "c", 2, " Base"), row(4, "d", 2, "solana")])
    write(spark, folder, 2, [row(9, "e", 1)])
    found = ingest.run_complete(ingest.daily_counts(ingest.stream_table(spark, folder, "snapshot", files_per_batch=1)), "daily")
    assert sorted((r.chain, r.day.day, r.records, r.highest_block) for r in found.collect()) == [("base", 1, 2, 9), ("base", 2, 2, 3), ("solana", 2, 1, 4)]


def test_once_within_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, 1, [row(1, "a"), row(2, "a"), row(3, "b")])
    rows = ingest.once(ingest.stream_table(spark, folder, "snapshot"), ["chain", "contract_address", "token_id"])
    query = rows.writeStream.format("memory").queryName("once_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once_rows").groupBy("token_id").agg(F.count(F.lit(1)).alias("n")).filter("n <> 1").count() == 0 and spark.table("once_rows").count() == 2
