"""Mixing sources to target shares of the tokens."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.functions.permutations import permuted, unpermuted
from twinledger.llm.tokens import Tokenizer, tokenised
from twinledger.runtime import land

#: the plan of draws has at most so many output shards, whatever the corpus; larger corpora get larger shards
MOST_SHARDS = 4096
#: blocks of a shard that one group of rows holds
PART_BLOCKS = 1024
#: characters of text that a task tokenises, tokens that it assembles
TASK_CHARS, TASK_TOKENS = 64_000_000, 32_000_000


def _starts(batches):
    """Adds the place of each text among those of its source in this task; rows come by source and document."""
    source, at = None, 0
    for batch in batches:
        starts = []
        for s, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if s != source:
                source, at = s, 0
            starts.append(at)
            at += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], [*batch.schema.names, "inner"])


def placed(documents: DataFrame, tokenizer: Tokenizer | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, doc_id, n, tokens, at) of texts with a source, and (source, tokens) of the sources.

    at: the token at which a text begins if the texts of its source stand end to end in the order of doc_id. Texts are range-partitioned by
    source and doc_id, whatever the ids look like, and tokenised there, which is all that moves; a task counts from its own first text, and
    the sums of the tasks before it are added, a table of as many rows as there are tasks and sources. Documents with a null source or text are left out.
    """
    spark = documents.sparkSession
    given = documents.filter(F.col("source").isNotNull() & F.col("text").isNotNull()).select("source", "doc_id", "text")
    chars = given.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first().c
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, chars // TASK_CHARS)
    ordered = given.repartitionByRange(count, "source", "doc_id").sortWithinPartitions("source", "doc_id")
    each = tokenised(ordered, ["source", "doc_id"], tokenizer=tokenizer, as_list=True, scan=False)
    docs = each.mapInArrow(_starts, "source string, doc_id long, n long, tokens array<int>, inner long").withColumn("part", F.spark_partition_id())
    docs = land(docs, "tokens")
    sums = docs.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = land(sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    out = docs.join(F.broadcast(bases.select("source", "part", "base")), ["source", "part"])
    return out.select("source", "doc_id", "n", "tokens", (F.col("base") + F.col("inner")).alias("at")), bases.groupBy("source").agg(F.sum("n").alias("tokens"))


def pieces(docs: DataFrame, length: int) -> DataFrame:
    """(source, block, at, doc_id, start, n, tokens): what each document gives to each block of ``length`` tokens; at: the place in its source."""
    size = F.lit(length)
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)

    def piece(b):
        start = F.greatest(b * size - F.col("at"), F.lit(0))
        end = F.least((b + 1) * size - F.col("at"), F.col("n"))
        return F.struct(b.alias("block"), (F.col("at") + start).alias("at"), start.alias("start"), (end - start).alias("n"), F.slice("tokens", (start + 1).cast("int"), (end - start).cast("int")).alias("tokens"))

    cut = docs.filter("n > 0").select("source", "doc_id", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return cut.select("source", "p.block", "p.at", "doc_id", "p.start", "p.n", "p.tokens")


def _joined(cut: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks from their pieces: keys, n, tokens and docs, the (doc_id, start, n) that the tokens come from, in order."""
    parts = F.sort_array(F.collect_list(F.struct("at", "doc_id", "start", "n", "tokens")))
    whole = cut.groupBy(*keys).agg(parts.alias("p"))
    links = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["n"].alias("n")))
    return whole.select(*keys, F.flatten("p.tokens").alias("tokens"), links.alias("docs")).select(*keys, F.size("tokens").alias("n"), "tokens", "docs")


def blocks(documents: DataFrame, length: int, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(source, block, n, tokens, docs): the texts of each source end to end in the order of doc_id, cut every ``length`` tokens.

    The last block of a source may be shorter; nothing is dropped. docs names the documents of a block: doc_id, first token and number of tokens.
    """
    return _joined(pieces(placed(documents, tokenizer)[0], length), ["source", "block"])


@dataclass(frozen=True)
class Source:
    name: str
    share: float
    repeats: int
    blocks: int


def totals(sources: list[Source], wanted: int | None = None) -> list[int]:
    """How many blocks each source gives.

    Without ``wanted`` the most for which every source that has blocks can hold its share within its repeats: the scarcest source sets the
    size of all. With it, a mixture of so many blocks, in which a source that can't hold its share gives all it may; the shares reached tell.
    Shares of sources without blocks (or without repeats) go to the others in proportion. Largest remainders round to whole blocks.
    """
    able = np.array([s.share * (s.blocks * s.repeats > 0) for s in sources], float)
    if not able.sum():
        return [0] * len(sources)
    able /= able.sum()
    cap = np.array([s.blocks * s.repeats for s in sources])
    total = int(min(c / a for c, a in zip(cap, able) if a > 0) + 1e-9) if wanted is None else wanted
    exact = able * total
    count = np.minimum(np.floor(exact + 1e-9).astype(int), cap)
    short = max(0, total - int(np.floor(exact + 1e-9).sum()))
    for i in np.argsort(-(exact - np.floor(exact + 1e-9)), kind="stable")[:short]:
        count[i] += able[i] > 0 and count[i] < cap[i]
    return count.tolist()


#: from so many blocks on numpy has no exact draw
_EXACT = 10**9


def _draw(left: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source among ``take`` of those left, drawn without replacement; beyond _EXACT blocks by the normal law, rounded and within bounds."""
    if left.sum() < _EXACT:
        return rng.multivariate_hypergeometric(left, take, method="marginals")
    out, rest, n = np.zeros_like(left), int(left.sum()), take
    for i, k in enumerate(left.tolist()):
        p = k / rest if rest else 0.0
        spread = np.sqrt(max(0.0, n * p * (1 - p) * (rest - n) / max(1, rest - 1)))
        out[i] = min(max(round(rng.normal(n * p, spread)), n - (rest - k), 0), k, n)
        rest, n = rest - k, n - int(out[i])
    return out


def draws(count: list[int], shard_blocks: int, seed: int) -> list[list[int]]:
    """Blocks of each source in each output shard: multinomial draws given their totals, so that the totals, and caps, hold exactly.

    Shards have shard_blocks, or more where there would be more than MOST_SHARDS of them, so the plan has a bounded size.
    """
    rng, left, out = np.random.default_rng(seed), np.array(count, np.int64), []
    size = max(shard_blocks, -(-int(left.sum()) // MOST_SHARDS)) if len(left) else shard_blocks
    while left.sum():
        take = _draw(left, min(size, int(left.sum())), rng)
        out.append(take.tolist())
        left -= take
    return out


@dataclass(frozen=True)
class Plan:
    """drawn: blocks of each source (columns) in each shard (rows), MOST_SHARDS at most. counts, sizes: blocks each source gives and has."""

    drawn: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray
    seed: int

    def key(self, k: np.ndarray, passes: np.ndarray) -> np.ndarray:
        return (np.uint64(self.seed) << np.uint64(40)) + (k.astype(np.uint64) << np.uint64(20)) + passes.astype(np.uint64)

    def slots(self, k: np.ndarray, block: np.ndarray, passes: np.ndarray) -> np.ndarray:
        """The slot of its source that a block takes in a pass: the one that the permutation of source and pass leads from; -1 if that is beyond the blocks drawn."""
        n = self.sizes[k]
        slot = passes * n + unpermuted(block, n, self.key(k, passes))
        return np.where(slot < self.counts[k], slot, -1)

    def places(self, k: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, position) of slots: the slots of a source fill its draws shard by shard; within a shard all places are permuted."""
        ends = np.cumsum(self.drawn, axis=0)
        before = np.cumsum(self.drawn, axis=1) - self.drawn
        shard = np.zeros(len(slot), np.int64)
        for source in np.unique(k):
            own = k == source
            shard[own] = np.searchsorted(ends[:, source], slot[own], side="right")
        local = slot - (ends - self.drawn)[shard, k] + before[shard, k]
        return shard, permuted(local, self.drawn.sum(axis=1)[shard], self.key(shard + (1 << 19), np.zeros(len(shard), np.int64)))


def mixture(documents: DataFrame, targets: DataFrame, length: int = 512, shard_blocks: int = 1024, seed: int = 7, tokenizer: Tokenizer | None = None, total_blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: (shard, position, source_name, block, pass, n, tokens, docs), the blocks of each output shard in shuffled order; pass is the
    repeat of the source, from 0; docs names the documents that a block's tokens come from. shares: per target its target_share, the tokens and
    blocks there are, those drawn, the share reached and the part of the source's blocks that is used.

    Targets are a small configuration table, one row per source; a null name, share or cap is refused. Totals are the most for which
    all shares hold, or what total_blocks asks for (see totals); per shard they are drawn (see draws); slot i of a source holds block
    permutation(i mod blocks) of pass i div blocks, so a block comes again only once all have come. Each piece of a text finds the slots of
    its block by the inverse permutation, so the blocks meet their slots where the text lies and tokens move once, to their shard. A source
    without documents gets nothing and is reported with 0.
    """
    spark = documents.sparkSession
    given = targets.select("source_name", "target_share", "max_repeats").orderBy("source_name").collect()
    if any(v is None for r in given for v in r):
        raise ValueError("targets hold nulls")
    wanted = documents.join(F.broadcast(targets.select(F.col("source_name").alias("source"))), "source", "left_semi")
    docs, per_source = placed(wanted, tokenizer)
    tokens = {r.source: r.tokens for r in per_source.collect()}  # a row per target
    sources = [Source(r.source_name, r.target_share, r.max_repeats, -(-tokens.get(r.source_name, 0) // length)) for r in given]
    counts = totals(sources, total_blocks)
    plan = Plan(np.array(draws(counts, shard_blocks, seed), np.int64).reshape(-1, len(sources)), np.array(counts, np.int64), np.array([s.blocks for s in sources], np.int64), seed)

    @F.pandas_udf("shard int, position long")
    def place(k: pd.Series, block: pd.Series, passes: pd.Series) -> pd.DataFrame:
        k, block, passes = (x.to_numpy().astype(np.int64) for x in (k, block, passes))
        slot = plan.slots(k, block, passes)
        shard, position = np.full(len(slot), -1, np.int64), np.zeros(len(slot), np.int64)
        used = slot >= 0
        shard[used], position[used] = plan.places(k[used], slot[used])
        return pd.DataFrame({"shard": shard.astype(np.int32), "position": position})

    able = [(s.name, k, (c - 1) // s.blocks) for k, (s, c) in enumerate(zip(sources, counts)) if c]
    known = F.broadcast(spark.createDataFrame(able, "source string, k int, last_pass int"))
    cut = pieces(docs.join(known, "source", "left_semi"), length).join(known, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), "last_pass")))
    chosen = cut.withColumn("s", place("k", "block", "pass")).filter("s.shard >= 0").select("s.*", F.col("source").alias("source_name"), "block", "pass", "at", "doc_id", "start", "n", "tokens")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts) * length // TASK_TOKENS)
    moved = chosen.withColumn("part", F.floor(F.col("position") / PART_BLOCKS)).repartition(tasks, "shard", "part")
    mixed = _joined(moved, ["shard", "part", "position", "source_name", "block", "pass"]).drop("part")

    rows = []
    drawn = [_drawn_tokens(plan, k, tokens.get(s.name, 0), length) for k, s in enumerate(sources)]
    for s, c, t in zip(sources, counts, drawn):
        rows.append((s.name, s.share, s.repeats, tokens.get(s.name, 0), s.blocks, t, c, -(-c // s.blocks) if c else 0, t / (sum(drawn) or 1), min(c, s.blocks) / s.blocks if s.blocks else 0.0))
    return mixed, spark.createDataFrame(rows, "source_name string, target_share double, max_repeats int, source_tokens long, source_blocks long, drawn_tokens long, drawn_blocks long, passes int, reached_share double, used_share double")


def _drawn_tokens(plan: Plan, k: int, tokens: int, length: int) -> int:
    """Tokens of the blocks drawn from a source: all blocks are full but its last one, which counts as often as it is drawn."""
    count, blocks = int(plan.counts[k]), int(plan.sizes[k])
    if not count:
        return 0
    passes = np.arange(-(-count // blocks))
    last = plan.slots(np.full(len(passes), k), np.full(len(passes), blocks - 1), passes)
    return count * length - int((last >= 0).sum()) * (blocks * length - tokens)
