"""Copies that only formatting hides, kept in a ledger that grows batch by batch."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm.terms import terms
from twinledger.runtime import land, release, remove_path

#: A key with more than this share of all records is hot; there are at most its reciprocal many.
HOT_SHARE = 1 / 1000


def _joined(text: Column) -> Column:
    return F.array_join(terms(text), " ")


def text_key(text: Column) -> Column:
    """The terms of a text in order; empty if it has none, null for null."""
    return _joined(text)


def uri_key(uri: Column) -> Column:
    """The terms before the first ``?`` in order, then the parameters after it, each as its terms, in sorted order; those without terms dropped."""
    at = F.instr(uri, "?")
    path = F.when(at > 0, F.substring(uri, F.lit(1), at - 1)).otherwise(uri)
    query = F.when(at > 0, F.substring(uri, at + 1, F.length(uri))).otherwise(F.lit(""))
    parameters = F.array_sort(F.filter(F.transform(F.split(query, "&"), _joined), lambda p: p != ""))
    return F.concat_ws("?", _joined(path), *[F.when(F.size(parameters) > 0, F.array_join(parameters, "&"))])


def record_key(name: Column, token_uri: Column, image_uri: Column) -> Column:
    """The canonical form of a record, null unless each of its three fields has a term. Terms hold none of the signs that join them."""
    parts = [text_key(name), uri_key(token_uri), uri_key(image_uri)]
    given = parts[0] != ""
    for p in parts[1:]:
        given = given & (F.regexp_replace(p, r"[?& ]", "") != "")
    return F.when(given, F.concat_ws("\n", *parts))


def keyed(records: DataFrame, key: Column, record: str) -> DataFrame:
    """(key_a, key_b, record, ...) of records that have a key: 128 bits of hash, two of the functions with different seeds."""
    found = records.withColumn("__key", key).filter(F.col("__key").isNotNull())
    a, b = F.xxhash64("__key"), F.xxhash64(F.lit("second"), F.col("__key"))
    return found.select(a.alias("key_a"), b.alias("key_b"), F.col(record).alias("record"), *[c for c in found.columns if c == "batch"])


class CopyLedger:
    """For each canonical key how many records had it and the earliest (smallest) record that had.

    Rows lie in hash buckets. A batch is aggregated by key, outer-joined with the ledger's rows of the buckets it touches, and only
    these buckets are written anew, into a folder of their own that no other attempt uses. Then a small manifest with the next number is
    put beside the earlier ones by one rename; it names the folder of each bucket and the batches taken in. The ledger is what the
    manifest with the highest number says, and nothing that it or the one before names is deleted before the new one is in place. So an
    update that fails at any step leaves the ledger as it was, and a batch that is given again changes nothing. One writer at a time:
    of two, the later finds the number taken and fails.

    Files are sorted by bucket, so the row groups of other buckets are skipped. buckets: for a new ledger; an existing one keeps its own.
    """

    SCHEMA = "bucket int, key_a long, key_b long, copies long, record long"
    KEY = ["bucket", "key_a", "key_b"]

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self._new_buckets = spark, path.rstrip("/"), max(1, buckets)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in names) if m)

    def manifest(self) -> dict:
        """The latest manifest; an empty one for a ledger that is not there yet."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "count": self._new_buckets, "buckets": {}, "batches": []}
        stream = self._fs.open(self._path(f"{self.path}/manifest-{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Makes a manifest the latest one: written whole under another name, then renamed to a name that must be free."""
        part = self._path(f"{self.path}/part-{manifest['version']}-{uuid.uuid4().hex}")
        at = self._path(f"{self.path}/manifest-{manifest['version']}.json")
        stream = self._fs.create(part, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if self._fs.exists(at) or not self._fs.rename(part, at):
            raise OSError(f"cannot publish {at}")

    def _sweep(self, now: dict) -> None:
        """Deletes manifests and folders that the latest manifest no longer needs."""
        for version in self._versions():
            if version < now["version"]:
                self._fs.delete(self._path(f"{self.path}/manifest-{version}.json"), False)
        used = set(now["buckets"].values())
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if re.fullmatch(r"v\d+-[0-9a-f]+", name) and name not in used or name.startswith("part-"):
                remove_path(self.spark, f"{self.path}/{name}")

    def bucketed(self, keys: DataFrame) -> DataFrame:
        """Rows with key_a as this ledger keeps them: with their bucket."""
        return keys.withColumn("bucket", F.pmod("key_a", F.lit(self.manifest()["count"])).cast("int"))

    def rows(self, buckets: set[int] | None = None) -> DataFrame:
        """The ledger, or its rows in some buckets."""
        by_folder: dict[str, list[int]] = {}
        for b, folder in self.manifest()["buckets"].items():
            if buckets is None or int(b) in buckets:
                by_folder.setdefault(folder, []).append(int(b))
        out = self.spark.createDataFrame([], self.SCHEMA)
        for folder, own in by_folder.items():
            out = out.unionByName(self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{folder}").filter(F.col("bucket").isin(own)))
        return out

    def take(self, batch: DataFrame, name: str) -> None:
        """Takes in a batch of (key_a, key_b, record)."""
        before = self.manifest()
        if name in before["batches"]:
            return
        counted = batch.groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("copies"), F.min("record").alias("record"))
        counted = land(self.bucketed(counted), "batch")
        touched = {r.bucket for r in counted.select("bucket").distinct().collect()}  # at most the number of buckets
        version = before["version"] + 1
        folder = f"v{version}-{uuid.uuid4().hex}"
        if touched:
            old = self.rows(touched).select(*self.KEY, F.col("copies").alias("old_copies"), F.col("record").alias("old_record"))
            merged = counted.join(old, self.KEY, "full_outer").select(
                *self.KEY,
                (F.coalesce("copies", F.lit(0)) + F.coalesce("old_copies", F.lit(0))).alias("copies"),
                F.least("record", "old_record").alias("record"),
            )
            merged.sortWithinPartitions(*self.KEY).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        now = before | {"version": version, "buckets": before["buckets"] | {str(b): folder for b in touched}, "batches": [*before["batches"], name]}
        self._publish(now)
        release(counted)
        self._sweep(now)


def copies_of(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(record, copy): of each key with several records the earliest and every other one.

    rows, ledger: with key_a and key_b. Hot keys, those of more than HOT_SHARE of the records and so at most its reciprocal many, are
    broadcast from the ledger to all rows, which so stay where they are; only rows without a hot key are joined by shuffle.
    """
    on = ["key_a", "key_b"]
    several = ledger.filter("copies > 1").select(*on, F.col("record").alias("first"), "copies")
    total = ledger.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("__total")).scalar()
    marked = several.withColumn("hot", F.col("copies") > F.greatest(F.lit(1000), total * HOT_SHARE))
    hot, cold = marked.filter("hot").select(*on, "first"), marked.filter("not hot").select(*on, "first")
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return near.unionByName(far).filter("record <> first").select(F.col("first").alias("record"), F.col("record").alias("copy"))
