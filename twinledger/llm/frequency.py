"""Occurrences and records of every distinct value or term, by external sort and run-length scan."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.identity import is_blank
from twinledger.llm.terms import terms
from twinledger.runtime import land, spread

RUNS = "field_name string, item string, occurrences long, records long"


def _runs(batches, weights):
    """Run-length totals of a stream sorted by (item, field, ...): each run once, one row of state between batches."""
    open_run = None  # field, item, occurrences, records
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        field, item = batch.column(0), batch.column(1)
        same = pc.and_(pc.equal(field.slice(1), field.slice(0, n - 1)), pc.equal(item.slice(1), item.slice(0, n - 1)))
        starts = [0, *(pc.indices_nonzero(pc.invert(same)).to_numpy() + 1).tolist()]
        occurrences, records = weights(batch, starts)
        f, i = field.take(pa.array(starts)).to_pylist(), item.take(pa.array(starts)).to_pylist()
        if open_run and (open_run[0], open_run[1]) == (f[0], i[0]):
            occurrences[0] += open_run[2]
            records[0] += open_run[3]
        elif open_run:
            f, i, occurrences, records = [open_run[0], *f], [open_run[1], *i], [open_run[2], *occurrences], [open_run[3], *records]
        open_run = (f[-1], i[-1], occurrences[-1], records[-1])
        yield _out(f[:-1], i[:-1], occurrences[:-1], records[:-1])
    if open_run:
        yield _out(*([x] for x in open_run))


def _out(f, i, o, r) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(i, pa.string()), pa.array(o, pa.int64()), pa.array(r, pa.int64())], ["field_name", "item", "occurrences", "records"])


def _of_pairs(batches):
    """Over (field, item, record) pairs: occurrences are rows, records the changes of record within the run."""
    import numpy as np

    last = [None]

    def weights(batch, starts):
        n = batch.num_rows
        record = batch.column(2).to_numpy(zero_copy_only=False)
        fresh = np.ones(n, bool)
        fresh[1:] = record[1:] != record[:-1]
        fresh[starts] = True
        key = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), record[0])
        if key == last[0]:
            fresh[0] = False
        last[0] = (batch.column(0)[n - 1].as_py(), batch.column(1)[n - 1].as_py(), record[n - 1])
        occurrences = np.diff([*starts, n])
        return occurrences.tolist(), np.add.reduceat(fresh.astype(np.int64), starts).tolist()

    yield from _runs(batches, weights)


def _of_runs(batches):
    """Over runs of several tasks: both counts add up, as no record lies in two tasks."""
    import numpy as np

    def weights(batch, starts):
        return (np.add.reduceat(batch.column(k).to_numpy(), starts).tolist() for k in (2, 3))

    yield from _runs(batches, weights)


def item_counts(pairs: DataFrame) -> DataFrame:
    """RUNS of (field_name, item, record): how often each item occurs and in how many records.

    Each task sorts its own pairs (spilling as needed) and scans them by run length, which leaves one row per item and task; only
    these runs are range-partitioned by item, sorted again and scanned. So a hot item moves one row per task, and a range of items
    lies in one task in order. All pairs of a record must come from one row of the source, as they do when items are exploded from
    the record: then records of different tasks differ and their numbers add up. Repeated rows with ids of their own are records of
    their own. Null items are left out; an empty input gives no rows.
    """
    pairs = pairs.filter(F.col("item").isNotNull()).select("field_name", "item", "record")
    runs = pairs.sortWithinPartitions("item", "field_name", "record").mapInArrow(_of_pairs, RUNS)
    runs = land(runs, "runs")  # the range partitioner samples its input, which must not count everything twice
    ranges = max(1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return runs.repartitionByRange(ranges, "item", "field_name").sortWithinPartitions("item", "field_name").mapInArrow(_of_runs, RUNS)


def verdicts(counts: DataFrame, totals: DataFrame, too_rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """Counts with ``verdict``: rare in fewer than too_rare_below records, common in more than the share common_above of the field's
    records (totals: field_name, n; one row per field), else useful."""
    share = F.col("records") > F.col("n") * F.lit(common_above)
    return counts.join(F.broadcast(totals), "field_name").withColumn("verdict", F.when(F.col("records") < too_rare_below, "rare").when(share, "common").otherwise("useful")).drop("n")


def snapshot_pairs(snapshot: DataFrame) -> DataFrame:
    """(field_name, item, record): terms of non-blank metadata_json, and non-blank token URIs as they are."""
    of_terms = F.when(~is_blank(F.col("metadata_json")), terms(F.col("metadata_json")))
    of_uri = F.when(~is_blank(F.col("token_uri_norm")), F.array("token_uri_norm"))
    found = spread(snapshot.select("row_id", "metadata_json", "token_uri_norm")).select("row_id", F.explode(F.array(F.struct(F.lit("metadata_json").alias("f"), of_terms.alias("i")), F.struct(F.lit("token_uri_norm").alias("f"), of_uri.alias("i")))).alias("x"))
    return found.select(F.col("x.f").alias("field_name"), F.explode("x.i").alias("item"), F.col("row_id").alias("record"))


def snapshot_totals(snapshot: DataFrame) -> DataFrame:
    """Rows with something in the field, per field."""
    n = snapshot.select(*(F.count(F.when(~is_blank(F.col(c)), 1)).alias(c) for c in ("metadata_json", "token_uri_norm")))
    return n.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("n")) for c in n.columns))).alias("x")).select("x.*")


def snapshot_frequencies(snapshot: DataFrame) -> DataFrame:
    """field_name, item, occurrences, records, verdict over a snapshot."""
    return verdicts(item_counts(snapshot_pairs(snapshot)), snapshot_totals(snapshot))
