"""Snapshot rows as a stream: events once within a watermark, running counts, and tables that grow by what they lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinledger.identity import tidy_address, tidy_chain
from twinledger.operators.staging import insert_absent
from twinledger.runtime import shared_path


def stream_table(spark: SparkSession, folder: str, name: str, schema: StructType | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table ``<folder>/<name>.parquet``, one file or a folder of them, as a stream."""
    path = f"{folder}/{name}.parquet"
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory()
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _timed(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def once(rows: DataFrame, key: list[str], time: str = "ingested_at", late: str = "45 days") -> DataFrame:
    """A stream's rows, of each key only the first within the watermark; state older than ``late`` is dropped. Rows of unknown time pass the
    watermark as the oldest, so give them a time first if they matter."""
    return _timed(rows, time).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def daily_counts(rows: DataFrame, time: str = "ingested_at", late: str = "45 days") -> DataFrame:
    """(chain, day, records, highest_block) of rows per chain and day; the state is one row per chain and day within the watermark."""
    tidy = _timed(rows, time).withColumn("chain", tidy_chain(F.col("chain"))).withWatermark(time, late)
    return tidy.groupBy("chain", F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("records"), F.max("first_seen_block").alias("highest_block")).select("chain", F.col("w.start").alias("day"), "records", "highest_block")


def run_complete(counts: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over all that is there now and returns its result table, which lies in the shared folder.

    Each batch replaces the table by writing a new one; only the last is read.
    """
    spark = counts.sparkSession
    base = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{number}")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId", 0)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{last}")
    while last > 0 and not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        last -= 1
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{last}")
    return spark.read.parquet(f"{base}/{last}")


def grow(rows: DataFrame, base: str, key: list[str], order: list[str]) -> int:
    """Runs a stream into a table at ``base``: each batch adds the keys that the table lacks; the number of batches so far.

    A batch writes its own folder, overwritten if the batch runs again, and compares with the folders of earlier batches only, so a
    restart adds nothing twice.
    """
    spark = rows.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        before = [f"{base}/table/batch={n}" for n in range(number)]
        first = insert_absent(batch.limit(0), batch, key, order)
        fresh = first.join(spark.read.schema(batch.schema).parquet(*before).select(*key), key, "left_anti") if before else first
        fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{base}/table/batch={number}")

    query = rows.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(add).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def token_keys(rows: DataFrame) -> DataFrame:
    """Rows with tidied chain and contract."""
    return rows.withColumns({"chain": tidy_chain(F.col("chain")), "contract_address": tidy_address(F.col("chain"), F.col("contract_address"))})
