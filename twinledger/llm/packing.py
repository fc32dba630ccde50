"""Packing texts into containers of fixed capacity by vector best-fit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.tokens import Tokenizer, tokenised
from twinledger.runtime import land


@dataclass(frozen=True)
class Rules:
    """Limits of one container and how to choose it.

    Its tokens are at most the capacity C; its documents at most C / tokens_per_document; its attention cost, the sum of the squared
    lengths, at most attention * C * C. As lengths add up to C at most, a limit of C * C would never bind; at the default one an item of
    more than 0.95 C takes no others in. An item that exceeds the limit by itself, as one of length C does, gets a container of its own. rule: ``norm`` puts an item where the weighted norm of what then remains is least, ``dot``
    where the weighted dot product of item and remainder is greatest. weights: of tokens, documents and attention cost.
    """

    tokens_per_document: int = 8
    attention: float = 0.9
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.1)


def best_fit(sizes: np.ndarray, capacity: int, rules: Rules = Rules()) -> np.ndarray:
    """The container of each item, 0, 1, ...; items, none larger than the capacity, are placed by decreasing size, ties in given order.

    A new container opens only if no open one has room in every dimension; it takes its first item whatever its attention cost.
    """
    weights = np.array(rules.weights)
    limit = np.array([capacity, max(1, capacity // rules.tokens_per_document), rules.attention * capacity * capacity], float)
    left = np.empty((3, max(1, len(sizes))))
    into = np.empty(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    smallest = sizes.min() if len(sizes) else 0
    ids = np.empty(max(1, len(sizes)), np.int64)  # of the open containers
    live = opened = 0
    for i in order:
        need = np.array([sizes[i], 1.0, float(sizes[i]) ** 2])
        room = left[:, :live]
        fits = np.flatnonzero((room[0] >= need[0]) & (room[1] >= 1) & (room[2] >= need[2]))
        if len(fits):
            after = (room[:, fits] - need[:, None]) / limit[:, None]
            if rules.rule == "norm":
                at = fits[np.argmin(weights @ (after * after))]
            else:
                at = fits[np.argmax((weights * need / limit) @ (room[:, fits] / limit[:, None]))]
        else:
            at, live = live, live + 1
            left[:, at], ids[at] = limit, opened
            opened += 1
        left[:, at] -= need
        into[i] = ids[at]
        if left[0, at] < smallest or left[1, at] < 1:  # closed: the last open one takes its place
            live -= 1
            left[:, at], ids[at] = left[:, live], ids[live]
    return into


def pack(documents: DataFrame, capacities: list[tuple[int, int]], rules: Rules = Rules(), shard_tokens: int = 2_000_000, shard_items: int = 20_000, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(capacity_id, capacity_tokens, shard, bin, doc_id, piece, start, n): where every document lies, for each capacity.

    Documents longer than a capacity are split into pieces of exactly it and a rest, no other is; start and n are in tokens. Texts are
    whole and tokenised once. Documents are spread by hash over shards, whose number follows the input, so that a shard has about
    shard_tokens or shard_items at most; each shard and capacity is packed by itself, which leaves one container or two not full in
    each. Null texts have no item; an empty text is an item of size 0. Capacities below 1 are refused. No documents give no rows.
    """
    if any(c < 1 for _, c in capacities):
        raise ValueError("capacities start at 1")
    sizes = land(tokenised(documents, ["doc_id"], tokenizer=tokenizer), "sizes")
    total, count = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    shards = max(1, -(-(total or 0) // shard_tokens), -(-count // shard_items))
    kinds = F.array(*(F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity_tokens")) for i, c in capacities))
    each = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).select("shard", "doc_id", "n", F.explode(kinds).alias("k")).select("shard", "doc_id", "n", "k.*")
    last = F.greatest(F.ceil(F.col("n") / F.col("capacity_tokens")), F.lit(1)).cast("int") - 1
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * F.col("capacity_tokens")
    pieces = pieces.select("capacity_id", "capacity_tokens", "shard", "doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.col("capacity_tokens").cast("long")).alias("n"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece"]).reset_index(drop=True)
        group["bin"] = best_fit(group["n"].to_numpy(), int(group["capacity_tokens"].iloc[0]), rules)
        return group[["capacity_id", "capacity_tokens", "shard", "bin", "doc_id", "piece", "start", "n"]]

    schema = "capacity_id int, capacity_tokens int, shard int, bin long, doc_id long, piece int, start long, n long"
    return pieces.groupBy("capacity_id", "shard").applyInPandas(one, schema)


def fill(packed: DataFrame) -> DataFrame:
    """capacity_id, containers, items, tokens, fill: how much of its containers each capacity uses."""
    bins = packed.groupBy("capacity_id", "capacity_tokens", "shard", "bin").agg(F.sum("n").alias("used"), F.count(F.lit(1)).alias("items"))
    return bins.groupBy("capacity_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), (F.sum("used") / F.sum(F.col("capacity_tokens").cast("long"))).alias("fill")
    )
