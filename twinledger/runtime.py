"""Session helpers: reading tables, the shared working folder and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED_KEY = "spark.checkpoint.dir"
#: paths that land() wrote in this process and are left, oldest first, one list for each open scope
_scopes: list[list[str]] = [[]]


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("twinledger")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where the session names none, a local master gets a temporary folder (tests); a cluster without the setting is an error, as a
    machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(SHARED_KEY) or spark.conf.get(SHARED_KEY, None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {SHARED_KEY} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="twinledger-")
        spark.conf.set(SHARED_KEY, named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str, *partition_by: str, outer: bool = False) -> DataFrame:
    """Writes df as a compressed table in the shared folder and reads it back, without its lineage. outer: the table is a result of the innermost open
    landing_scope, which does not end with it.

    A table rather than checkpoint(): it is smaller on disk, read by column, and its plan starts anew, where a checkpointed plan keeps
    the constraints of all rounds before it, which in a loop outgrow the driver.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    landed = df.sparkSession.read.schema(df.schema).parquet(path)
    landed.landed_at = path
    _scopes[max(0, len(_scopes) - 1 - outer)].append(path)
    return landed


def release(*tables: DataFrame) -> None:
    """Deletes tables that land() wrote, once nothing reads them any more."""
    for df in tables:
        remove_path(df.sparkSession, df.landed_at)
        for paths in _scopes:
            if df.landed_at in paths:
                paths.remove(df.landed_at)


@contextmanager
def landing_scope(spark: SparkSession) -> Iterator[None]:
    """What land() writes within is deleted at the end; tables of other runs, also of the same process, stay. Store results before it ends."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove_path(spark, path)


def release_all(spark: SparkSession) -> int:
    """Deletes what land() wrote in the innermost open scope, the whole process if none is open, and is left. Returns how many.

    Frames that read these tables can't be used any more; where others are still in use, open a landing_scope for each run instead.
    """
    own = _scopes[-1]
    count = len(own)
    while own:
        remove_path(spark, own.pop())
    return count


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system; a missing one is no error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, reduced to the given columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan whose files make fewer partitions than there are cores, over all cores; any other scan as it is.

    For work that takes long per row on inputs of a few files. Only such small inputs are moved. Use it on scans (with filters and
    projections) alone, as asking for the partitions of a plan with shuffles would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
