"""Graphs of addresses within contracts: edges, strongly connected groups, fans and chains of hand-overs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.operators.events import CONTRACT
from twinledger.runtime import land, release


def address_edges(moved: DataFrame) -> DataFrame:
    """(contract, src, dst): the distinct directed edges; those with a missing end and loops are dropped."""
    edges = moved.select(*CONTRACT, F.col("from_address").alias("src"), F.col("to_address").alias("dst"))
    return edges.filter("src is not null and dst is not null and src <> dst").distinct()


#: contracts with up to so many edges are handled whole by a task; a task's batch of edges has at most this and one batch more
WHOLE_EDGES = 200_000
#: layers that one pass of trimming takes off
LAYERS = 4


def strong_components(edges: DataFrame, whole_edges: int = WHOLE_EDGES) -> DataFrame:
    """(contract, component, v): the strongly connected groups of two or more addresses, known by their smallest address.

    Contracts with at most whole_edges distinct edges go to tasks by hash and are searched there, many at once; that bound is checked by
    counting first. Of larger ones, of which there are few, no task gets the graph: they are searched in rounds over all tasks, see
    _in_rounds. Both give the same groups. Loops and repeated edges don't matter; null ends must be left out before.
    """
    edges = land(edges.select(*CONTRACT, "src", "dst").filter("src <> dst").distinct(), "edges")
    large = land(edges.groupBy(*CONTRACT).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole_edges).select(*CONTRACT), "large")
    few = edges.join(F.broadcast(large), CONTRACT, "left_anti")
    n = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = few.repartition(n, *CONTRACT).sortWithinPartitions(*CONTRACT).mapInArrow(_components_of_batches(whole_edges), "chain string, contract_address string, component string, v string")
    if large.isEmpty():
        return found
    return found.unionByName(_in_rounds(edges.join(F.broadcast(large), CONTRACT, "left_semi")))


def _components_of_batches(most: int):
    """Of a stream of edges sorted by contract: the groups of all contracts that are complete, as soon as there are enough edges."""
    names = [*CONTRACT, "src", "dst"]

    def run(batches):
        held = None
        for batch in batches:
            held = pa.concat_tables([t for t in (held, pa.Table.from_batches([batch])) if t is not None])
            if held.num_rows >= most:
                chain, contract = (held.column(c) for c in CONTRACT)
                last = pc.and_(pc.equal(chain, chain[-1]), pc.equal(contract, contract[-1]))
                yield from found(held.filter(pc.invert(last)))
                held = held.filter(last)
        if held is not None:
            yield from found(held)

    def found(table):
        if not table.num_rows:
            return
        pdf = table.select(names).to_pandas()
        contract = pdf.groupby(CONTRACT, sort=False).ngroup().to_numpy()
        both = pd.MultiIndex.from_arrays([np.r_[contract, contract], np.r_[pdf["src"], pdf["dst"]]])
        code, vertex = both.factorize()
        group = strong_groups(code[: len(pdf)], code[len(pdf) :], len(vertex))
        out = pd.DataFrame({"k": vertex.get_level_values(0), "v": vertex.get_level_values(1), "g": group})
        out = out[out.groupby("g")["v"].transform("size") > 1]
        out["component"] = out.groupby("g")["v"].transform("min")
        first = pdf[CONTRACT].groupby(contract).first()
        for c in CONTRACT:
            out[c] = first[c].reindex(out["k"]).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(out[c].tolist(), pa.string()) for c in (*CONTRACT, "component", "v")], [*CONTRACT, "component", "v"])

    return run


def strong_groups(src: np.ndarray, dst: np.ndarray, n: int) -> list[int]:
    """A number for each of n vertices, the same for those that reach each other: one search in depth with low marks, its stack kept by hand."""
    order = np.argsort(src, kind="stable")
    to, start = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    seen, low, group = [0] * n, [0] * n, [-1] * n
    at, open_, time, groups = start[:-1].copy(), [], 0, 0
    for root in range(n):
        if seen[root]:
            continue
        path = [root]
        time += 1
        seen[root] = low[root] = time
        open_.append(root)
        while path:
            v = path[-1]
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    time += 1
                    seen[w] = low[w] = time
                    open_.append(w)
                    path.append(w)
                elif group[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                while True:
                    w = open_.pop()
                    group[w] = groups
                    if w == v:
                        break
                groups += 1
    return group


def _flow(edges: DataFrame) -> DataFrame:
    """(contract, v, label): the smallest vertex that reaches each vertex, itself among them.

    A label that reaches a vertex is itself reached by its own label, so each round takes labels one edge on and then jumps from a label to its
    label; the rounds grow as the logarithm of the longest way, not as its length, as long as labels don't lie against their order.
    """
    labels = land(edges.select(*CONTRACT, F.col("src").alias("v")).distinct().withColumn("label", F.col("v")), "flow")
    while True:
        step = edges.join(labels.withColumnRenamed("v", "src"), [*CONTRACT, "src"]).select(*CONTRACT, F.col("dst").alias("v"), "label")
        near = land(labels.unionByName(step).groupBy(*CONTRACT, "v").agg(F.min("label").alias("label")), "near")
        on = near.select(*CONTRACT, F.col("v").alias("label"), F.col("label").alias("next"))
        fresh = land(near.join(on, [*CONTRACT, "label"], "left").select(*CONTRACT, "v", F.least("label", "next").alias("label")), "flow")
        same = fresh.join(labels.withColumnRenamed("label", "old"), [*CONTRACT, "v"]).filter("old <> label").isEmpty()
        release(near, labels)
        labels = fresh
        if same:
            return labels


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that lie on no cycle, as their source is reached by nobody or their target reaches nobody, LAYERS deep at a time, until none is left to take."""
    size = edges.count()
    while size:
        fewer = edges
        for _ in range(LAYERS):
            sources, targets = fewer.select(*CONTRACT, F.col("src").alias("dst")).distinct(), fewer.select(*CONTRACT, F.col("dst").alias("src")).distinct()
            fewer = fewer.join(sources, [*CONTRACT, "dst"], "left_semi").join(targets, [*CONTRACT, "src"], "left_semi")
        fewer = land(fewer.select(*CONTRACT, "src", "dst"), "edges")
        before, size = size, fewer.count()
        release(edges)
        edges = fewer
        if size == before:
            break
    return edges


def _in_rounds(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """strong_components in DataFrames, so that no contract's graph must fit a task.

    Edges on no cycle are trimmed. On the rest each vertex takes the smallest vertex that reaches it; of the vertices with one such label,
    those that reach the label's vertex are its group; what remains goes round again. Tables of earlier rounds are deleted. Ways that
    branch at every step and lie on no cycle are trimmed by LAYERS hops a pass.
    """
    left, found = land(edges.select(*CONTRACT, "src", "dst"), "edges"), None
    for _ in range(max_rounds):
        left = _trimmed(left)
        if left.isEmpty():
            break
        color = _flow(left)
        c = color.withColumnRenamed("label", "color")
        same = left.join(c.withColumnRenamed("v", "src").withColumnRenamed("color", "c1"), [*CONTRACT, "src"]).join(c.withColumnRenamed("v", "dst").withColumnRenamed("color", "c2"), [*CONTRACT, "dst"])
        within = land(same.filter("c1 = c2").select(*CONTRACT, "src", "dst", F.col("c1").alias("color")), "within")
        # against the edges, from each color's own vertex
        reach = land(color.filter("v = label"), "reach")
        count = reach.count()
        while True:
            step = within.join(reach.select(*CONTRACT, F.col("v").alias("dst"), F.col("label").alias("color")), [*CONTRACT, "dst", "color"]).select(*CONTRACT, F.col("src").alias("v"), F.col("color").alias("label"))
            fresh = land(reach.unionByName(step).distinct(), "reach")
            before, count = count, fresh.count()
            release(reach)
            reach = fresh
            if count == before:
                break
        several = reach.groupBy(*CONTRACT, "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        groups = land(reach.join(several, [*CONTRACT, "label"], "left_semi").select(*CONTRACT, F.col("label").alias("component"), "v"), "groups")
        found = groups if found is None else found.unionByName(groups)
        gone = reach.select(*CONTRACT, "v")
        rest = within.join(gone.withColumnRenamed("v", "src"), [*CONTRACT, "src"], "left_anti").join(gone.withColumnRenamed("v", "dst"), [*CONTRACT, "dst"], "left_anti")
        rest = land(rest.select(*CONTRACT, "src", "dst"), "edges")
        release(left, color, within, reach)
        left = rest
    else:
        raise RuntimeError(f"groups remain after {max_rounds} rounds")
    if found is None:
        found = edges.select(*CONTRACT, F.col("src").alias("component"), F.col("src").alias("v")).limit(0)
    return found


def instances(moved: DataFrame, components: DataFrame, value: str) -> DataFrame:
    """(contract, component, events, addresses, tokens, first_at, last_at, first_block, last_block, value): per group the moves between its members, with the sum of a value, negative ones as 0."""
    member = components.select(*CONTRACT, "component", "v")
    inner = moved.filter("from_address <> to_address").join(member.withColumnRenamed("v", "from_address"), [*CONTRACT, "from_address"]).join(member.withColumnRenamed("v", "to_address"), [*CONTRACT, "component", "to_address"])
    inner = land(inner.select(*CONTRACT, "component", "from_address", "token_id", "block_ts", "block_number", F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0))).alias("x")), "inner")
    key = [*CONTRACT, "component"]
    sums = inner.groupBy(*key).agg(F.count(F.lit(1)).alias("events"), F.min("block_ts").alias("first_at"), F.max("block_ts").alias("last_at"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"), F.sum("x").alias("value"))
    distinct = lambda c, name: inner.select(*key, c).filter(F.col(c).isNotNull()).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    return sums.join(distinct("from_address", "addresses"), key, "left").join(distinct("token_id", "tokens"), key, "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))


def cycle_sizes(components: DataFrame) -> DataFrame:
    """(size_class, groups, addresses): how many groups of 2, 3, 4, and 5 or more addresses there are."""
    sizes = components.groupBy(*CONTRACT, "component").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") >= 5, "5+").otherwise(F.col("n").cast("string"))
    return sizes.groupBy(kind.alias("size_class")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("addresses"))


def fans(edges: DataFrame, least: int = 3) -> DataFrame:
    """(contract, address, direction, others): addresses that sent to (out) or got from (in) at least so many different others."""
    out = edges.groupBy(*CONTRACT, F.col("src").alias("address")).agg(F.count(F.lit(1)).alias("others")).withColumn("direction", F.lit("out"))
    into = edges.groupBy(*CONTRACT, F.col("dst").alias("address")).agg(F.count(F.lit(1)).alias("others")).withColumn("direction", F.lit("in"))
    return out.unionByName(into).filter(F.col("others") >= least).select(*CONTRACT, "address", "direction", "others")


def inventories(moved: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """(contract, address, sources, tokens, token_share, value_share): of addresses that at least so many others sent to, the share of the contract's tokens they
    got, and of what was paid for its mints; null where nothing was."""
    got = moved.filter("to_address is not null and token_id is not null").select(*CONTRACT, F.col("to_address").alias("address"), "token_id").distinct()
    totals = moved.filter("token_id is not null").select(*CONTRACT, "token_id").distinct().groupBy(*CONTRACT).agg(F.count(F.lit(1)).alias("all_tokens"))
    into = fans(edges, least).filter("direction = 'in'").select(*CONTRACT, "address", F.col("others").alias("sources"))
    held = got.groupBy(*CONTRACT, "address").agg(F.count(F.lit(1)).alias("tokens"))
    paid = moved.filter("mint_payment_native > 0 and mint_payment_receiver is not null").groupBy(*CONTRACT, F.col("mint_payment_receiver").alias("address")).agg(F.sum("mint_payment_native").alias("paid"))
    all_paid = paid.groupBy(*CONTRACT).agg(F.sum("paid").alias("all_paid"))
    joined = into.join(held, [*CONTRACT, "address"]).join(totals, CONTRACT).join(paid, [*CONTRACT, "address"], "left").join(all_paid, CONTRACT, "left")
    share = F.when(F.col("all_paid") > 0, F.coalesce("paid", F.lit(0.0)) / F.col("all_paid"))
    return joined.select(*CONTRACT, "address", "sources", "tokens", (F.col("tokens") / F.col("all_tokens")).alias("token_share"), share.alias("value_share"))


def handovers(moved: DataFrame, least: int = 3) -> DataFrame:
    """(contract, token_id, path_no, hops, addresses, path): runs of moves of one token, in order of time, block and transaction, in which each
    receiver sends on next, with at least so many different addresses. Moves of unknown time or a missing end are left out."""
    timed = moved.filter("token_id is not null and block_ts is not null and from_address is not null and to_address is not null")
    order = Window.partitionBy(*CONTRACT, "token_id").orderBy("block_ts", "block_number", "tx_hash", "from_address", "to_address")
    starts = F.when(F.col("from_address").eqNullSafe(F.lag("to_address").over(order)), 0).otherwise(1)
    numbered = timed.withColumn("at", F.row_number().over(order)).withColumn("starts", starts)
    runs = numbered.withColumn("path_no", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    steps = F.sort_array(F.collect_list(F.struct("at", "from_address", "to_address")))
    paths = runs.groupBy(*CONTRACT, "token_id", "path_no").agg(steps.alias("s"))
    path = F.concat(F.array(F.col("s")[0]["from_address"]), F.col("s.to_address"))
    out = paths.select(*CONTRACT, "token_id", F.col("path_no").cast("long").alias("path_no"), F.size("s").alias("hops"), F.size(F.array_distinct(path)).alias("addresses"), F.array_join(path, ">").alias("path"))
    return out.filter(F.col("addresses") >= least)


def layered_paths(moved: DataFrame, starts: DataFrame, addresses: int = 3) -> DataFrame:
    """(contract, token_id, start, hops, path, first_block, last_block): for each token and starting address (chain, address) the first way over so many different addresses.

    Each hop is a later move of the token by the address that got it, later by block or, where a block is unknown, by time; the first way is the one
    whose first move is earliest, then its second, and so on (by block, time, transaction and receiver; unknown ones first). Ways are built hop by
    hop from the starts on, by joins on token and address. Moves without a token or an end are left out.
    """
    key = [*CONTRACT, "token_id"]
    order = F.struct("block_number", "block_ts", "tx_hash", F.col("to_address").alias("to"))
    events = moved.filter("token_id <> '' and from_address <> '' and to_address <> ''").select(*key, F.col("from_address").alias("src"), F.col("to_address").alias("dst"), order.alias("o")).distinct()
    begun = events.join(starts.select("chain", F.col("address").alias("src")).distinct(), ["chain", "src"], "left_semi").filter("src <> dst")
    ways = begun.select(*key, F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"), F.array("o").alias("os"))
    for _ in range(addresses - 2):
        following = events.select(*key, F.col("src").alias("last"), "dst", "o")
        before = F.element_at("os", -1)
        later = F.when(before["block_number"].isNotNull() & F.col("o.block_number").isNotNull(), before["block_number"] < F.col("o.block_number")).otherwise(before["block_ts"] < F.col("o.block_ts"))
        met = ways.join(following, [*key, "last"]).filter(later & ~F.array_contains("path", F.col("dst")))
        ways = met.select(*key, "start", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"), F.concat("os", F.array("o")).alias("os"))
    best = ways.groupBy(*key, "start").agg(F.min(F.struct("os", "path")).alias("b"))
    return best.select(*key, "start", (F.size("b.path") - 1).alias("hops"), F.array_join("b.path", ">").alias("path"), F.col("b.os")[0]["block_number"].alias("first_block"), F.element_at("b.os", -1)["block_number"].alias("last_block"))


def repeated_addresses(moved: DataFrame, least: int = 2) -> DataFrame:
    """(chain, address, contracts): addresses that moved tokens of at least so many contracts of a chain, as sender or receiver."""
    ends = moved.select("chain", "contract_address", F.explode(F.array("from_address", "to_address")).alias("address")).filter("address is not null").distinct()
    return ends.groupBy("chain", "address").agg(F.count(F.lit(1)).alias("contracts")).filter(F.col("contracts") >= least)


def cycle_exits(moved: DataFrame, components: DataFrame) -> DataFrame:
    """(contract, component, ended_at, inner_moves, first_exit_at, exits): per strongly connected group the last move within it, and the moves
    strictly after it from a member to an address outside; first_exit_at is null without any."""
    timed = moved.filter("block_ts is not null").select(*CONTRACT, F.col("from_address").alias("src"), F.col("to_address").alias("dst"), "block_ts")
    member = components.select(*CONTRACT, "component", "v")
    sent = timed.join(member.withColumnRenamed("v", "src"), [*CONTRACT, "src"])
    inside = member.select(*CONTRACT, F.col("component").alias("c2"), F.col("v").alias("dst"))
    marked = sent.join(inside, [*CONTRACT, "dst"], "left").withColumn("inner", F.coalesce(F.col("c2") == F.col("component"), F.lit(False)) & (F.col("src") != F.col("dst")))
    ends = marked.filter("inner").groupBy(*CONTRACT, "component").agg(F.max("block_ts").alias("ended_at"), F.count(F.lit(1)).alias("inner_moves"))
    left = marked.filter("not inner and dst is not null and src <> dst").join(ends.select(*CONTRACT, "component", "ended_at"), [*CONTRACT, "component"]).filter("block_ts > ended_at")
    exits = left.groupBy(*CONTRACT, "component").agg(F.min("block_ts").alias("first_exit_at"), F.count(F.lit(1)).alias("exits"))
    return ends.join(exits, [*CONTRACT, "component"], "left").withColumn("exits", F.coalesce("exits", F.lit(0)))
