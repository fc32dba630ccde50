"""Where results go: Parquet snapshots, CSV reports, manifests, and caches that know what they were made from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.runtime import land, remove_path


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or as it was before: written beside its place, which one rename then replaces."""
    fs, beside = _fs(spark, f"{path}.part")
    out = fs.create(beside, True)
    out.write(text.encode())
    out.close()
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    options = sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    at = fs.makeQualified(hadoop.Path(path))
    hadoop.FileContext.getFileContext(at.toUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), at, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(tables: Mapping[str, DataFrame], path: str, force: bool = False, form: str = "parquet", **options: str) -> None:
    """Several tables as folders below one path, all or none: written to a folder beside, which then takes the path's place.

    An existing path is refused unless force; then it is set aside until the new one is in place, and brought back if that fails.
    """
    def write(fresh: str) -> None:
        for name, df in tables.items():
            df.write.format(form).options(**options).save(f"{fresh}/{name}")

    _replace(next(iter(tables.values())).sparkSession, path, force, write)


def _replace(spark: SparkSession, path: str, force: bool, write: Callable[[str], None]) -> None:
    """Puts the folder that write() makes at a path; see publish."""
    fs, at = _fs(spark, path)
    if fs.exists(at) and not force:
        raise FileExistsError(f"{path} exists")
    fresh, old = f"{path}.fresh", f"{path}.old"
    remove_path(spark, fresh)
    write(fresh)
    had = fs.exists(at)
    if had:
        remove_path(spark, old)
        fs.rename(at, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, fresh)[1], at):
        if had:
            fs.rename(_fs(spark, old)[1], at)
        raise OSError(f"cannot publish {path}")
    remove_path(spark, old)


def write_snapshot(df: DataFrame, path: str, force: bool = False, rows_per_file: int = 1_000_000) -> None:
    """A snapshot as ZSTD Parquet by chain, so that readers of one chain read only its folders.

    It is written beside its place and renamed when whole, so a run that is lost leaves no half of it; an existing one is refused unless force.
    """
    _replace(df.sparkSession, path, force, lambda fresh: df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("chain").parquet(fresh))


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """A small result as one ordered CSV file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, facts: Mapping) -> None:
    """What a run read, took and found, as JSON."""
    write_text(spark, path, json.dumps(dict(facts), indent=1, sort_keys=True, default=str))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; refuses more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return _table(df.columns, [r.asDict() for r in rows])


def fingerprint(spark: SparkSession, paths: list[str], **parameters) -> str:
    """A hash of the input files (name, length, time of change) and parameters."""
    seen = []
    for p in sorted(paths):
        fs, at = _fs(spark, p)
        for s in fs.listStatus(at):
            seen.append((str(s.getPath()), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(seen), parameters], sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, path: str, mark: str, make) -> DataFrame:
    """The table at a path if it was made under the same mark (see fingerprint), else ``make()`` written there; the mark is written last."""
    if read_text(spark, f"{path}/MARK") != mark:
        remove_path(spark, path)
        make().write.option("compression", "zstd").parquet(f"{path}/table")
        write_text(spark, f"{path}/MARK", mark)
    return spark.read.parquet(f"{path}/table")



def write_tree(spark: SparkSession, path: str, tables: Mapping[str, Mapping[str, DataFrame]], most: int = 1000) -> list[str]:
    """Small results as a tree of reports: <folder>/<name>.json, one object with its rows, and <folder>/<name>.md beside it. Returns the files.

    A result of more than ``most`` rows is refused before anything is written, as it belongs in a table.
    """
    small = {f"{folder}/{name}": df.limit(most + 1).collect() for folder, of in tables.items() for name, df in of.items()}
    for name, rows in small.items():
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
    files = []
    for folder, of in tables.items():
        for name, df in of.items():
            rows = [r.asDict(recursive=True) for r in small[f"{folder}/{name}"]]
            write_text(spark, f"{path}/{folder}/{name}.json", json.dumps({"name": name, "rows": rows}, indent=1, default=str))
            write_text(spark, f"{path}/{folder}/{name}.md", f"# {name}\n\n{_table(df.columns, rows)}\n")
            files += [f"{path}/{folder}/{name}.json", f"{path}/{folder}/{name}.md"]
    return files


def _table(columns: list[str], rows: list[dict]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if r[c] is None else str(r[c]).replace("|", "\\|") for c in columns) + " |" for r in rows)])


def append_failures(failures: DataFrame, path: str, run: str) -> None:
    """Failures as lines of JSON, added to those of earlier runs; each knows its run. Reading the folder gives all."""
    failures.withColumn("run", F.lit(run)).write.mode("append").option("ignoreNullFields", "false").json(path)


def resumed(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What make() gives for the wanted keys, kept at a path: made only for keys that are not there yet, and added.

    Each call adds one folder, complete or not there, and a list of the keys it made, also of those with no rows, so a run that is lost
    makes its keys anew and nothing else. Keys are distinct and not null; make gets a frame of keys and returns rows with them.
    """
    fs, root = _fs(spark, path)
    parts = [str(f.getPath()) for f in fs.listStatus(root)] if fs.exists(root) else []
    done = [p for p in parts if p.rsplit("/", 1)[-1].startswith("part-")]
    lacking = wanted.select(*keys).distinct()
    for p in done:
        lacking = lacking.join(spark.read.parquet(f"{p}/keys"), keys, "left_anti")
    lacking = land(lacking, "lacking")
    if not lacking.isEmpty() or not done:
        fresh = f"{path}/fresh-{uuid.uuid4().hex}"
        make(lacking).write.option("compression", "zstd").parquet(f"{fresh}/rows")
        lacking.write.parquet(f"{fresh}/keys")
        place = f"{path}/part-{len(done):06d}-{uuid.uuid4().hex}"
        if not fs.rename(_fs(spark, fresh)[1], _fs(spark, place)[1]):
            raise OSError(f"cannot add to {path}")
        done.append(place)
    rows = reduce(DataFrame.unionByName, (spark.read.parquet(f"{p}/rows") for p in done))
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")
