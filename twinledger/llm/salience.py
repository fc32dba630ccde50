"""How much each term marks its record off from the whole collection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.identity import is_blank
from twinledger.llm.terms import TERM
from twinledger.operators.skew import HOT_SHARE, LEAST_HOT, spread_join
from twinledger.runtime import land, spread

#: the terms that are broadcast have at most so many bytes, counting TERM_BYTES for each beside its text; in memory some three times that
BROADCAST_BYTES, TERM_BYTES = 12_000_000, 32
CELLS = "record long, term string, n int, row_total long"


def _cells(batches):
    """Counts of each term of each record, over a batch at once."""
    for batch in batches:
        lists = pc.split_pattern_regex(batch.column(1), pattern=TERM.replace("[", "[^", 1))
        doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        real = np.asarray(pc.not_equal(words, ""))[code] if len(words) else np.zeros(0, bool)
        doc, code = doc[real], code[real]
        cell, n = np.unique(doc * np.int64(max(1, len(words))) + code, return_counts=True)
        doc, code = cell // max(1, len(words)), cell % max(1, len(words))
        total = np.bincount(doc, weights=n, minlength=len(lists)).astype(np.int64)
        for at in range(0, len(doc), 100_000):
            d, c = doc[at : at + 100_000], code[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), words.take(pa.array(c)), pa.array(n[at : at + 100_000].astype(np.int32)), pa.array(total[d])], ["record", "term", "n", "row_total"])


def cells(records: DataFrame, record: str, text: str) -> DataFrame:
    """The table of counts: CELLS, one row per record and term it has, with the record's margin. Null and blank texts have none.
    records: a scan, see runtime.spread."""
    return spread(records.select(F.col(record).cast("long").alias("record"), F.col(text).alias("text"))).filter(~is_blank(F.col("text"))).select("record", F.lower("text")).mapInArrow(_cells, CELLS)


def with_margins(found: DataFrame, margins: DataFrame) -> DataFrame:
    """Cells with the margins of their term: term_total, the occurrences, and term_records, the records that have it.

    The most frequent terms, up to BROADCAST_BYTES of them, are broadcast to the cells, which so stay in place; only cells of the rarer ones
    join by shuffle. Should a term too long to be broadcast be frequent, or the broadcast be full of others, its cells are spread over
    tasks (see operators.skew). margins: a landed table.
    """
    level = F.floor(F.log2("term_records") * 16).cast("int")  # some hundred levels for any collection
    size = F.sum(F.octet_length("term") + TERM_BYTES)
    levels = sorted(((r.level, r.n, r.b) for r in margins.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), size.alias("b")).collect()), reverse=True)
    floor_level, used, count = None, 0, 0
    for at, n, b in levels:
        if used + b > BROADCAST_BYTES:
            break
        floor_level, used, count = at, used + b, count + n
    if count == sum(n for _, n, _ in levels):
        return found.join(F.broadcast(margins), "term")
    top = margins.filter(level >= floor_level) if floor_level is not None else margins.limit(0)
    rest = margins.filter(level < floor_level) if floor_level is not None else margins
    near = found.join(F.broadcast(top), "term")
    far = found.join(F.broadcast(top.select("term")), "term", "left_anti")
    # the cells of a term are known from its margin, so hot ones need no count of their own
    limit = F.lit(float(max(LEAST_HOT, int(HOT_SHARE * (margins.agg(F.sum("term_records")).first()[0] or 0)))))
    hot = land(rest.filter(F.col("term_records") > limit).select("term", F.ceil(F.col("term_records") / limit).cast("int").alias("__parts")), "hot")
    return near.unionByName(spread_join(far, rest, ["term"], None if hot.isEmpty() else hot, ["record"]).select(*near.columns))


def term_margins(found: DataFrame) -> DataFrame:
    """(term, term_total, term_records) of all cells."""
    return found.groupBy("term").agg(F.sum("n").alias("term_total"), F.count(F.lit(1)).alias("term_records"))


def residual(n: Column, row_total: Column, term_total: Column, grand: Column) -> Column:
    """The adjusted residual of a cell: observed minus expected count over the root of the expectation, its variance corrected for both margins.

    Null where a margin is the whole table, so that nothing varies.
    """
    expected = row_total * term_total / grand
    variance = expected * (1 - row_total / grand) * (1 - term_total / grand)
    return F.when(variance > 0, (n - expected) / F.sqrt(variance))


def idf_score(n: Column, term_records: Column, records: Column) -> Column:
    """Count times the log of records over records with the term, rounded to 6 decimals."""
    return F.round(n * F.log(records / term_records), 6)


def scored(records: DataFrame, record: str, text: str, competes: Column | None = None, least_records: int = 1) -> DataFrame:
    """record, term, n, row_total, term_total, term_records, records, grand, residual, idf: every competing cell with both scores.

    All cells count for the margins. competes: a condition on the term. Terms in fewer than least_records records don't compete.
    """
    found = cells(records, record, text)
    margins = land(term_margins(found), "margins")
    sums = margins.agg(F.sum("term_total")).first()[0] or 0
    n = records.filter(~is_blank(F.col(text))).count()
    chosen = margins.filter(F.col("term_records") >= least_records)
    if competes is not None:
        found, chosen = found.filter(competes), chosen.filter(competes)
    joined = with_margins(found, land(chosen, "competing"))
    grand = F.lit(float(sums))
    return joined.select("*", F.lit(n).alias("records"), residual(F.col("n"), F.col("row_total"), F.col("term_total"), grand).alias("residual"), idf_score(F.col("n"), F.col("term_records"), F.lit(float(n))).alias("idf"))


def top_term(found: DataFrame, score: str) -> DataFrame:
    """(record, term, score): the highest of each record, at a tie the smaller term in byte order. A null score doesn't compete."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col("term").alias("t")))
    return found.filter(F.col(score).isNotNull()).groupBy("record").agg(best.alias("b")).select("record", F.col("b.t").alias("term"), (-F.col("b.s")).alias("score"))
