"""Contracts and tokens with the same or nearly the same name."""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.functions.similarity import PREFIX_MOST, jaro_winkler_many, least_common
from twinledger.functions.text import usable_name
from twinledger.identity import CASE_SENSITIVE_CHAIN
from twinledger.operators.eager import mode_per_key
from twinledger.operators.scopes import member_counts
from twinledger.runtime import land


def name_members(tokens: DataFrame) -> DataFrame:
    """(name, chain, contract_address, members, n): who bears a name.

    On most chains a contract bears its most frequent usable name (ties: the smaller) and stands for all its tokens. On the chain whose
    addresses are case-sensitive each token bears its own; members then counts its tokens.
    """
    named = tokens.filter(usable_name(F.col("name_norm")))
    counted = named.groupBy("chain", "contract_address", F.col("name_norm").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    own = counted.filter(F.col("chain") == CASE_SENSITIVE_CHAIN).select("name", "chain", "contract_address", F.col("n").alias("members"), "n")
    sizes = tokens.filter(F.col("chain") != CASE_SENSITIVE_CHAIN).groupBy("chain", "contract_address").agg(F.count(F.lit(1)).alias("n"))
    chosen = mode_per_key(counted.filter(F.col("chain") != CASE_SENSITIVE_CHAIN), ["chain", "contract_address"], "name")
    whole = chosen.join(sizes, ["chain", "contract_address"]).select("name", "chain", "contract_address", F.lit(1).cast("long").alias("members"), "n")
    return own.unionByName(whole)


#: names that one task compares with as many others, and the quotient of the lengths of one bucket
PART, BUCKET = 1 << 14, 1.15
#: pairs compared at once, and classes of characters whose numbers are compared
CELLS, CLASSES = 1 << 22, 64


def name_pairs(names: DataFrame, threshold: float, probe: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) of different names, a < b, with Jaro-Winkler similarity of at least the threshold; lossless.

    names: one column, name, distinct. probe: some of these names; then only pairs with one of them at least. Characters with their number
    of occurrence (a, a2, ...) make each name a set. From lengths and threshold follows how many of them two names must share, more where they
    don't begin with the same PREFIX_MOST characters. All names whose lengths allow a match are compared, in blocks of up to PART names of
    about one length, by the parity of their sets in 64 bits: some two nanoseconds a pair, far less than the rows that a join by rare
    characters makes, as all names consist of the same few. What remains is compared by the numbers of characters of each class, and then scored.
    A threshold above 1 gives no pairs; one of 0 or less is refused, as every pair would match: `scopes.all_match_counts` counts them
    without making any. Empty and null names match nothing.
    """
    if threshold <= 0:
        raise ValueError("every pair matches; count them by scopes.all_match_counts")
    if threshold > 1:
        return names.sparkSession.createDataFrame([], "a string, b string, similarity double")
    given = names.filter("name is not null and name <> ''").select("name")
    flag = F.lit(True) if probe is None else F.coalesce("asked", F.lit(False))
    if probe is not None:
        given = given.join(probe.select("name").distinct().withColumn("asked", F.lit(True)), "name", "left")
    length = F.length("name")
    sized = given.select("name", flag.alias("asked"), length.alias("len"), F.floor(F.log(length.cast("double")) / math.log(BUCKET)).cast("int").alias("bucket"))
    sized = land(sized, "names")
    counts = sized.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"), F.min("len").alias("lo"), F.max("len").alias("hi"))
    # buckets with lengths that can match: the shortest quotient decides, so the ends of the ranges do
    meet = land(_meeting(counts, threshold), "buckets")
    others = lambda x, y: meet.select(F.col(f"bucket_{x}").alias("bucket"), F.col(f"bucket_{y}").alias("other"), F.col(f"parts_{x}").alias("parts"), F.col(f"parts_{y}").alias("others"))

    def side(x: str, y: str) -> DataFrame:
        each = sized.join(F.broadcast(others(x, y)), "bucket").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts").cast("long")).cast("int"))
        each = each.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        return each.select(*(F.col(c).alias(k) for c, k in zip(("bucket", "other", "part", "peer") if x == "a" else ("other", "bucket", "peer", "part"), GROUP)), "name", "asked", "len", F.lit(x).alias("side")).filter("ba < bb or pa <= pb")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        left, right = (block[block["side"] == x].sort_values(["len", "name"], ignore_index=True) for x in "ab")
        a, b = _compare(left, right, threshold, block["ba"].iloc[0] == block["bb"].iloc[0] and block["pa"].iloc[0] == block["pb"].iloc[0])
        score = jaro_winkler_many(a, b)
        kept = [(min(a[i], b[i]), max(a[i], b[i]), score[i]) for i in np.flatnonzero(score >= threshold)]
        return pd.DataFrame(kept, columns=["a", "b", "similarity"])

    return side("a", "b").unionByName(side("b", "a")).groupBy(*GROUP).applyInPandas(compare, "a string, b string, similarity double")


GROUP = ["ba", "bb", "pa", "pb"]


def _meeting(counts: DataFrame, threshold: float) -> DataFrame:
    """(bucket_a, bucket_b, parts_a, parts_b), bucket_a <= bucket_b, of buckets of lengths (bucket, parts, lo, hi) that hold lengths which can match."""
    @F.udf("boolean")
    def can(hi, lo):
        return hi >= lo or least_common(hi, lo, threshold) <= hi

    side = lambda x: counts.select(*(F.col(c).alias(f"{c}_{x}") for c in counts.columns))
    return side("a").join(F.broadcast(side("b")), F.col("bucket_a") <= F.col("bucket_b")).filter(can("hi_a", "lo_b")).select("bucket_a", "bucket_b", "parts_a", "parts_b")


def _signs(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each name the parity of its marks in 64 bits, the number of its characters of each class, and the number of its beginning (-1 if shorter)."""
    bits: dict[tuple[str, int], int] = {}
    parity, numbers, begins = np.zeros(len(names), np.uint64), np.zeros((len(names), CLASSES), np.uint16), np.full(len(names), -1)
    seen: dict[str, int] = {}
    for i, name in enumerate(names):
        own = 0
        for c, n in Counter(name).items():
            numbers[i, ord(c) % CLASSES] += n
            for k in range(n):
                bit = bits.get((c, k))
                if bit is None:
                    bit = bits[c, k] = 1 << (crc32(f"{k} {c}".encode("utf-8", "surrogatepass")) & 63)
                own ^= bit
        parity[i] = own
        if len(name) >= PREFIX_MOST:
            begins[i] = seen.setdefault(name[:PREFIX_MOST], len(seen))
    return parity, numbers, begins


def _compare(left: pd.DataFrame, right: pd.DataFrame, threshold: float, same: bool) -> tuple[list[str], list[str]]:
    """The pairs of names of two blocks in order of length that can reach the threshold; same: both are one block, whose pairs count once."""
    if not len(left) or not len(right) or not (left["asked"].any() or right["asked"].any()):
        return [], []
    a, b = left["name"].tolist(), right["name"].tolist()
    parity, numbers, begins = _signs(a + b)
    ask, asked = left["asked"].to_numpy(bool), right["asked"].to_numpy(bool)
    spans = lambda x: [(int(n), np.flatnonzero(x["len"].to_numpy() == n)) for n in x["len"].unique()]
    out: tuple[list[str], list[str]] = ([], [])
    for la, rows in spans(left):
        for lb, cols in spans(right):
            begun, apart = (least_common(la, lb, threshold, p) for p in (PREFIX_MOST, PREFIX_MOST - 1))
            if begun > min(la, lb) or (same and la > lb):
                continue
            # those asked for meet all, the others only those asked for
            for x, y in ((rows[ask[rows]], cols), (rows[~ask[rows]], cols[asked[cols]])):
                step = max(1, CELLS // max(1, len(y)))
                for at in range(0, len(x) if len(y) else 0, step):
                    i, j = np.nonzero(np.bitwise_count(parity[x[at : at + step], None] ^ parity[len(a) + y]) <= la + lb - 2 * begun)
                    i, j = x[at : at + step][i], y[j]
                    for part in range(0, len(i), CELLS // CLASSES):
                        p, q = i[part : part + CELLS // CLASSES], j[part : part + CELLS // CLASSES]
                        common = np.minimum(numbers[p], numbers[len(a) + q]).sum(axis=1)
                        alike = (begins[p] >= 0) & (begins[p] == begins[len(a) + q])
                        fits = np.flatnonzero((common >= np.where(alike, begun, apart)) & ((p < q) if same else True))
                        out[0].extend(a[k] for k in p[fits])
                        out[1].extend(b[k] for k in q[fits])
    return out


def name_counts(members: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Scope counts of members whose name others bear, exactly or by the given pairs of names; see scopes.member_counts."""
    return member_counts(members, pairs, "name")


def seed_name_edges(members: DataFrame, seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seed_chain, seed_address, candidate_chain, candidate_address, score): other contracts that bear a name of a seed, or a similar one.

    pairs: similar names, as name_pairs gives them, for which the seeds' names suffice as probe. Each seed and candidate are one edge, of the highest score; equal names score 1.
    """
    key = seeds.select("chain", "contract_address").distinct()
    own = members.join(key, ["chain", "contract_address"], "left_semi").select(F.col("chain").alias("seed_chain"), F.col("contract_address").alias("seed_address"), F.col("name").alias("seed_name")).distinct()
    both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    wanted = own.select("*", F.col("seed_name").alias("name"), F.lit(1.0).alias("score")).unionByName(own.join(both, F.col("seed_name") == F.col("a")).select(*own.columns, F.col("b").alias("name"), F.col("similarity").alias("score")))
    found = members.select(F.col("chain").alias("candidate_chain"), F.col("contract_address").alias("candidate_address"), "name").join(wanted, "name")
    other = found.filter((F.col("seed_chain") != F.col("candidate_chain")) | (F.col("seed_address") != F.col("candidate_address")))
    return other.groupBy("seed_chain", "seed_address", "candidate_chain", "candidate_address").agg(F.max("score").alias("score"))
