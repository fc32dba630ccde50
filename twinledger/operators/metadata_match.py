"""Contracts whose metadata documents are nearly the same by BM25 cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.functions.similarity import B, IDF_ONCE, IDF_SHARED, K1
from twinledger.functions.text import token_order
from twinledger.identity import CASE_SENSITIVE_CHAIN
from twinledger.operators.scopes import all_match_counts, member_counts
from twinledger.operators.skew import hot_keys, spread_join
from twinledger.runtime import land, landing_scope, release


def documents_of(anchors: DataFrame) -> DataFrame:
    """(doc, terms array<struct<term, tf>>, length, s0, s1): the distinct documents, known by 128 bits of their text, with their term counts
    and the parity of their terms in 128 bits."""
    distinct = anchors.select("document").distinct().select(doc_key(F.col("document")).alias("doc"), "document")

    def count(batches):
        import re
        from collections import Counter
        from zlib import crc32

        word = re.compile(r"[^\W_]+")
        bits: dict[str, int] = {}
        low = (1 << 64) - 1
        for batch in batches:
            terms, tfs, ends, lengths, sketches = [], [], [0], [], []
            for text in batch.column(1).to_pylist():
                counts = Counter(word.findall(text))
                own = sorted(counts)
                sketch = 0
                for t in own:
                    bit = bits.get(t)
                    if bit is None:
                        if len(bits) > 500_000:
                            bits.clear()
                        bit = bits[t] = 1 << (crc32(t.encode("utf-8", "replace")) & 127)
                    sketch ^= bit
                terms += own
                tfs += map(counts.__getitem__, own)
                ends.append(len(terms))
                lengths.append(counts.total())
                sketches.append(sketch)
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], ["term", "tf"])
            halves = (pa.array(np.array([x >> at & low for x in sketches], np.uint64).view(np.int64)) for at in (0, 64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(lengths, pa.int32()), *halves], ["doc", "terms", "length", "s0", "s1"])

    return distinct.mapInArrow(count, "doc string, terms array<struct<term:string,tf:int>>, length int, s0 long, s1 long")


def doc_key(document):
    return F.concat(F.hex(F.xxhash64(document)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), document)))


#: slots of the table of term counts, and so the size of what is broadcast, whatever the input
SLOTS = 1 << 20


def _limits(threshold: float, parts: int = 8):
    """For the term counts of documents, rare terms first: of each document how many of the first terms a similar one must share one of, and
    how many of all terms it may lack. Counts of all documents lie in one array; ends: where each begins, and the end of all.

    By Cauchy's inequality the score is at most the root of S / (U + S): S the squared weight of the shared terms, U that of the others.
    All terms of a document have the same length factor K in one comparison, somewhere between that of length 0 and that of twice the
    mean; relative to a term that occurs once, weights grow with K. Over each part of that range its two ends bound the quotient.
    Squares are summed up as whole numbers of 2^-30, rounded so that no bound gets closer, as sums over many documents would lose digits.
    """
    bounds = np.linspace(K1 * (1 - B), K1 * (1 + B), parts + 1)
    odds = (IDF_SHARED / IDF_ONCE) ** 2 * (1 / threshold**2 - 1) * (1 + 1e-9)  # U <= odds * S in these units
    unit = 1 << 30

    def of(tf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(ends)
        some = np.flatnonzero(sizes)
        first, lacks = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        if not len(some):
            return first, lacks
        starts, size = ends[:-1][some], sizes[some]
        mine = np.repeat(np.arange(len(some)), size)
        rank = np.arange(len(tf)) - starts[mine] + 1
        tf = tf.astype(float)
        squares = [(tf * (1 + x) / (tf + x)) ** 2 * unit for x in bounds]
        prefix, most = np.zeros(len(some), np.int64), np.zeros(len(some))
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        for low, high in zip(squares, squares[1:]):
            unshared, all_ = upto(np.floor(low).astype(np.int64)), upto(np.ceil(high).astype(np.int64))
            total = all_[starts + size] - all_[starts]
            lost = unshared[1:] - unshared[starts][mine]
            left = total[mine] - (all_[1:] - all_[starts][mine])
            beyond = lost > odds * left + 4  # after so many unshared terms
            prefix = np.maximum(prefix, np.minimum.reduceat(np.where(beyond, rank, size[mine]), starts))
            most = np.maximum(most, odds * total / unit)
        first[some], lacks[some] = prefix, np.minimum(size, (most + 1e-6).astype(np.int64))
        return first, lacks

    return of


def similar_documents(docs: DataFrame, threshold: float, probe: DataFrame | None = None) -> DataFrame:
    """(doc_a, doc_b, score), doc_a < doc_b: different documents whose cosine reaches the threshold, lossless. probe: (doc) of some documents; then
    only pairs with one of them at least.

    Each document's terms are ordered by rarity; documents that share none of the first few cannot reach the threshold (see _limits), so
    these join by equality, and the parity of all terms rules out most that lack too many of each other's terms; a term that
    very many documents ask for is spread over tasks. The rest is scored in columns, in one pass over the terms of both. Terms of one document only never join. Documents without terms match none. A threshold above 1 gives no pairs;
    one of 0 or less is refused, as every pair would match.
    """
    if threshold <= 0:
        raise ValueError("every pair matches; metadata_counts counts them without pairs")
    limits = _limits(min(threshold, 1.0))
    spark = docs.sparkSession
    # a term is known by 64 bits here: terms that share them join as one, and the scores tell them apart
    placed = docs.select("doc", "s0", "s1", F.transform("terms", lambda t: F.xxhash64(t["term"])).alias("hs"), F.col("terms.tf").alias("tfs"))
    # how often terms occur, in a table of fixed size; terms of one slot count together, which changes their order only, for all documents alike
    got = placed.select(F.explode("hs").alias("h")).groupBy(F.pmod("h", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    often = spark.sparkContext.broadcast(counts)

    def first_terms(batches):
        for batch in batches:
            lists, tfs = batch.column(3), batch.column(4)
            h, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy()
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            of = np.repeat(np.arange(len(lists)), np.diff(ends))
            n = often.value[h & (SLOTS - 1)]
            order = np.lexsort((h, n, of))
            prefix, lacks = limits(tf[order], ends)
            kept = np.flatnonzero((np.arange(len(h)) - ends[of] < prefix[of]) & (n[order] > 1))
            docs_ = pa.array(of[kept])
            yield pa.RecordBatch.from_arrays([pa.array(h[order][kept]), *(batch.column(k).take(docs_) for k in range(3)), pa.array(lacks[of[kept]].astype(np.int32))], ["term", "doc", "s0", "s1", "lacks"])

    short = land(placed.mapInArrow(first_terms, "term long, doc string, s0 long, s1 long, lacks int"), "short")
    mine = short if probe is None else short.join(probe.select("doc").distinct(), "doc", "left_semi")
    x, y = (of.select("term", *(F.col(c).alias(f"{c}_{k}") for c in ("doc", "s0", "s1", "lacks"))) for of, k in ((mine, "a"), (short, "b")))
    differ = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))
    met = spread_join(x, y, ["term"], hot_keys(short, ["term"]), ["doc_a"]).filter((F.col("doc_a") < F.col("doc_b") if probe is None else F.col("doc_a") != F.col("doc_b")) & (differ <= F.col("lacks_a") + F.col("lacks_b")))
    pairs = land(met.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).distinct(), "pairs")
    # terms move of documents in the slots of those in pairs only; there are at most SLOTS slots to broadcast
    place = lambda doc: F.pmod(F.xxhash64(doc), F.lit(SLOTS)).cast("int").alias("slot")
    met_slots = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).select(place("doc")).distinct()
    wanted = docs.withColumn("slot", place("doc")).join(F.broadcast(met_slots), "slot", "left_semi").drop("slot")
    return score_pairs(pairs, wanted).filter(F.col("score") >= threshold)


def score_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b, score) of given pairs of documents; a document with itself scores 1, one without shared terms 0."""
    side = lambda x: docs.select(F.col("doc").alias(f"doc_{x}"), F.map_from_entries("terms").alias(f"m_{x}"), F.col("length").alias(f"len_{x}"))
    both = pairs.join(side("a"), "doc_a").join(side("b"), "doc_b")
    mean = F.greatest((F.col("len_a") + F.col("len_b")) / 2, F.lit(1.0))
    factor = lambda x: K1 * (1 - B + B * F.col(f"len_{x}") / mean)

    def weight(tf, k):
        return F.coalesce(tf * (K1 + 1) / (tf + k), F.lit(0.0))

    each = F.map_values(F.map_zip_with("m_a", "m_b", lambda _, a, b: F.struct(weight(a, F.col("k_a")).alias("a"), weight(b, F.col("k_b")).alias("b"))))
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("dot", "a", "b")))

    def add(acc, w):
        idf = F.when((w["a"] > 0) & (w["b"] > 0), IDF_SHARED**2).otherwise(IDF_ONCE**2)
        return F.struct((acc["dot"] + idf * w["a"] * w["b"]).alias("dot"), (acc["a"] + idf * w["a"] * w["a"]).alias("a"), (acc["b"] + idf * w["b"] * w["b"]).alias("b"))

    # exploded, as a filter on the score would else repeat the sums for each place where it names them
    sums = both.withColumn("k_a", factor("a")).withColumn("k_b", factor("b")).withColumn("t", F.explode(F.array(F.aggregate(each, start, add))))
    cosine = F.when(F.col("t.dot") > 0, F.col("t.dot") / F.sqrt(F.col("t.a") * F.col("t.b"))).otherwise(0.0)
    return sums.select("doc_a", "doc_b", F.when(F.col("doc_a") == F.col("doc_b"), 1.0).otherwise(cosine).alias("score"))


UNIT = ["chain", "contract_address", "unit"]


def units_of(anchors: DataFrame, per_token: bool) -> DataFrame:
    """(UNIT, aligned, token_id, token_rank, doc): anchors with what is compared as one.

    A unit is a contract, with an empty ``unit``. On the chain with case-sensitive ids token ids say nothing, so contracts there are not aligned
    by them; with per_token each token is a unit of its own there.
    """
    apart = F.col("chain") == CASE_SENSITIVE_CHAIN
    unit = F.when(apart & F.lit(per_token), F.col("token_id")).otherwise(F.lit(""))
    return anchors.select("chain", "contract_address", unit.alias("unit"), (~apart).alias("aligned"), "token_id", token_order(F.col("token_id")).alias("token_rank"), F.col("doc") if "doc" in anchors.columns else doc_key(F.col("document")).alias("doc"))


def profiled(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, tops): the profile of each unit, and of each profile its highest token and document.

    members: (UNIT, profile); tops: (profile, aligned, token_rank, doc, and the UNIT of its smallest unit, which stands for it). Units with
    the same documents at the same token ids are one profile, known by 128 bits that are summed up in any order, so no unit's list is ever
    collected; units that aren't aligned are one profile if their highest tokens have the same document.
    """
    low, high = F.bit_xor(F.xxhash64("token_id", "doc")), F.bit_xor(F.xxhash64(F.lit("second"), "token_id", "doc"))
    per_unit = units.groupBy(*UNIT, "aligned").agg(low.alias("h1"), high.alias("h2"), F.count(F.lit(1)).alias("n"), F.max(F.struct("token_rank", "token_id", "doc")).alias("top"))
    listed = F.concat_ws("-", F.hex("h1"), F.hex("h2"), F.col("n").cast("string"))
    known = land(per_unit.select(*UNIT, "aligned", "top", F.when(F.col("aligned"), listed).otherwise(F.concat(F.lit("top-"), F.col("top.doc"))).alias("profile")), "units")
    first = known.groupBy("profile", "aligned").agg(F.min(F.struct(*UNIT, "top")).alias("f"))
    return known.select(*UNIT, "profile"), first.select("profile", "aligned", F.col("f.top.token_rank").alias("token_rank"), F.col("f.top.doc").alias("doc"), *(F.col(f"f.{c}").alias(c) for c in UNIT))


def similar_profiles(anchors: DataFrame, threshold: float = 0.6, per_token: bool = True, seeds: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, score) of different profiles, a < b, whose aligned documents match, and the profile of each unit.

    Two units are compared by the documents of their highest common token id; where none is common, or a side is not aligned by ids, by
    those of each one's highest. So a matching pair has a matching pair of documents, either at one token id or at both tops: these come
    first, from the similar and equal documents, and only such pairs are then aligned and kept if the alignment chooses just these
    documents. Units of one profile match as well and are not listed. Units with no valid document match none. A threshold above 1 leaves
    equal documents; one of 0 or less is refused, see similar_documents. seeds: (chain, contract_address); then only pairs with a profile of one.
    texts: (document), all that anchors have; anchors then hold their keys (doc, see doc_key) alone, so that texts move once.
    """
    with landing_scope(anchors.sparkSession):
        pairs, members = _similar_profiles(anchors, threshold, per_token, seeds, texts)
        return land(pairs, "profile-pairs", outer=True), land(members, "members", outer=True)


def _similar_profiles(anchors: DataFrame, threshold: float, per_token: bool, seeds: DataFrame | None, texts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    given = land(anchors.select("chain", "contract_address", "token_id", "document"), "anchors") if texts is None else anchors
    units = land(units_of(given, per_token), "units")
    docs = land(documents_of(given if texts is None else texts), "documents")
    if texts is None:
        release(given)
    members, tops = profiled(units)
    tops = land(tops, "tops")
    # the anchors of each profile, taken from the unit that stands for it
    held = tops.filter("aligned").select("profile", *UNIT)
    plain = spread_join(units.filter("aligned"), held, UNIT, hot_keys(units, UNIT), ["token_id"])
    plain = land(plain.select("profile", "token_id", "token_rank", "doc"), "anchors")
    mine = None
    if seeds is not None:
        wanted = members.join(seeds.select("chain", "contract_address").distinct(), ["chain", "contract_address"], "left_semi").select("profile").distinct()
        mine = land(wanted, "mine")
        probe = plain.join(mine, "profile", "left_semi").select("doc").unionByName(tops.join(mine, "profile", "left_semi").select("doc")).distinct()
    near = land(similar_documents(docs, threshold, None if mine is None else probe), "scores")
    same = docs.select(F.col("doc").alias("doc_a"), F.col("doc").alias("doc_b"), F.lit(1.0).alias("score"))
    near = land(near.unionByName(near.select(F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b"), "score")).unionByName(same), "near")

    left = plain if mine is None else plain.join(mine, "profile", "left_semi")
    at = lambda of, x: of.select(F.col("profile").alias(x), "token_id", "token_rank", F.col("doc").alias(f"doc_{x}"))
    # a token id and document stand for all profiles that hold them, so pairs of documents are found once per token id
    states = lambda of: of.select("token_id", "doc").distinct()
    joined = states(left).withColumnRenamed("doc", "doc_a").join(near, "doc_a").join(states(plain).withColumnRenamed("doc", "doc_b"), ["token_id", "doc_b"])
    one = F.col("a") < F.col("b") if mine is None else F.col("a") != F.col("b")
    common = joined.join(at(left, "a"), ["token_id", "doc_a"]).join(at(plain, "b").drop("token_rank"), ["token_id", "doc_b"]).filter(one)
    best = common.groupBy("a", "b").agg(F.max(F.struct("token_rank", "token_id", "score")).alias("m")).select("a", "b", "m.token_rank", "m.score")

    top = lambda of, x: of.select(F.col("profile").alias(x), F.col("doc").alias(f"doc_{x}"))
    own = tops if mine is None else tops.join(mine, "profile", "left_semi")
    of_tops = near.join(own.select(F.col("doc").alias("doc_a")).distinct(), "doc_a", "left_semi").join(tops.select(F.col("doc").alias("doc_b")).distinct(), "doc_b", "left_semi")
    by_top = of_tops.join(top(own, "a"), "doc_a").join(top(tops, "b"), "doc_b").filter(one).select("a", "b", F.col("score").alias("top_score"))

    candidates = land(best.join(by_top, ["a", "b"], "full_outer"), "candidates")
    # a pair is out if it shares a token id above the one that matched, or any where only the tops match; ids above either's highest are not looked at
    ends = lambda x: tops.filter("aligned").select(F.col("profile").alias(x), F.col("token_rank").alias(f"end_{x}"))
    ranked = candidates.join(ends("a"), "a").join(ends("b"), "b").select("a", "b", "token_rank", F.least("end_a", "end_b").alias("end"))
    above = ranked.join(at(plain, "a").select("a", "token_id", F.col("token_rank").alias("r")), "a").filter((F.col("r") <= F.col("end")) & (F.col("token_rank").isNull() | (F.col("r") > F.col("token_rank"))))
    beaten = above.select("a", "b", "token_id").join(plain.select(F.col("profile").alias("b"), "token_id"), ["b", "token_id"], "left_semi").select("a", "b").distinct()
    kept = candidates.join(beaten, ["a", "b"], "left_anti").select("a", "b", F.coalesce("score", "top_score").alias("score"))
    if mine is not None:
        kept = kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct()
    return kept, members


def similar_contracts(anchors: DataFrame, threshold: float = 0.6, seeds: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(chain_a, contract_a, chain_b, contract_b, score): contracts whose aligned documents match, the smaller first: those of similar_profiles, and
    those of one profile. seeds: only pairs with one of these contracts. texts: see similar_profiles."""
    pairs, members = similar_profiles(anchors, threshold, per_token=False, seeds=seeds, texts=texts)
    side = lambda x: members.select(F.col("profile").alias(x), F.col("chain").alias(f"chain_{x}"), F.col("contract_address").alias(f"contract_{x}"))
    several = members.groupBy("profile").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("profile").alias("a"), F.col("profile").alias("b"), F.lit(1.0).alias("score"))
    crowded = hot_keys(members, ["profile"], least=CROWDED)
    of = lambda x: None if crowded is None else crowded.withColumnRenamed("profile", x)
    every = pairs.select("a", "b", "score").unionByName(several)
    first = spread_join(side("a"), every, ["a"], of("a"), ["chain_a", "contract_a"])
    out = spread_join(first, side("b"), ["b"], of("b"), ["chain_a", "contract_a"])
    before = (F.col("chain_a") < F.col("chain_b")) | ((F.col("chain_a") == F.col("chain_b")) & (F.col("contract_a") < F.col("contract_b")))
    lo, hi = F.struct("chain_a", "contract_a"), F.struct("chain_b", "contract_b")
    placed = out.filter((F.col("a") != F.col("b")) | before).select(F.when(before, lo).otherwise(F.struct(F.col("chain_b").alias("chain_a"), F.col("contract_b").alias("contract_a"))).alias("x"), F.when(before, hi).otherwise(F.struct(F.col("chain_a").alias("chain_b"), F.col("contract_a").alias("contract_b"))).alias("y"), "score")
    found = placed.select("x.*", "y.*", "score")
    if seeds is None:
        return found
    key = land(seeds.select("chain", "contract_address").distinct(), "seeds")
    flagged = found.join(key.select(F.col("chain").alias("chain_a"), F.col("contract_address").alias("contract_a"), F.lit(True).alias("sa")), ["chain_a", "contract_a"], "left")
    flagged = flagged.join(key.select(F.col("chain").alias("chain_b"), F.col("contract_address").alias("contract_b"), F.lit(True).alias("sb")), ["chain_b", "contract_b"], "left")
    return flagged.filter("sa or sb").select("chain_a", "contract_a", "chain_b", "contract_b", "score")


#: contracts of one profile from which on their pairs are made by several tasks
CROWDED = 1_000


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs (chain_a, contract_a, chain_b, contract_b, score) as directed (chain, contract_address, peer_chain, peer_address, score)."""
    names = ["chain", "contract_address", "peer_chain", "peer_address", "score"]
    a, b = ["chain_a", "contract_a"], ["chain_b", "contract_b"]
    return pairs.select(*a, *b, "score").toDF(*names).unionByName(pairs.select(*b, *a, "score").toDF(*names))


def profile_members(members: DataFrame, tokens: DataFrame) -> DataFrame:
    """(name, chain, contract_address, members, n) for scopes.member_counts: the profiles of contracts, each standing for all tokens of it, and of
    tokens that are units of their own, each standing for itself."""
    sizes = tokens.filter(F.col("chain") != CASE_SENSITIVE_CHAIN).groupBy("chain", "contract_address").agg(F.count(F.lit(1)).alias("n"))
    whole = members.filter("unit = ''").join(sizes, ["chain", "contract_address"]).select(F.col("profile").alias("name"), "chain", "contract_address", F.lit(1).cast("long").alias("members"), "n")
    single = members.filter("unit <> ''").groupBy(F.col("profile").alias("name"), "chain", "contract_address").agg(F.count(F.lit(1)).alias("members"))
    return whole.unionByName(single.withColumn("n", F.col("members")))


def metadata_counts(anchors: DataFrame, tokens: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Scope counts of contracts, and of tokens of the chain with case-sensitive ids, whose documents match those of others: of their own profile or
    of a similar one. At a threshold of 0 or less everything with a valid document matches everything else, which is counted without pairs."""
    if threshold <= 0:
        members = units_of(anchors, True).select(*UNIT).distinct().withColumn("profile", F.lit("all"))
        return all_match_counts(profile_members(members, tokens), "metadata")
    pairs, members = similar_profiles(anchors, threshold)
    return member_counts(land(profile_members(members, tokens), "profile-members"), pairs, "metadata")
