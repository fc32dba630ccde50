"""Similarity self-join of sets by a grouped prefix join, for sets whose Jaccard similarity reaches a threshold.

Tokens of all sets have one order, rare ones first. Two sets with at least k common tokens among those that the threshold requires
share k of them within their prefixes, the first ``size - ceil(t * size) + k`` tokens. With k - 1 classes of tokens (by hash), two of
the shared ones fall into one class, so that every similar pair shares at least one *pair* of prefix tokens of one class; such pairs
are far rarer than single tokens. The steps:

1. count tokens into a table of fixed size, which gives the order,
2. sets with the same size and prefix form one group, and sets that are equal one class,
3. groups that share a pair of prefix tokens are candidates; sizes and a 64-bit parity sketch rule most of them out,
4. group pairs expand to pairs of their classes, which a 256-bit sketch and then the exact overlap verify.

A signature that very many groups share is spread over blocks of groups, each pair of which is compared in a task of its own; the joins of
steps 3 and 4 spread hot keys (see operators.skew). Nothing is dropped or capped: the order, sketches and classes only decide how few candidates there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.operators.skew import hot_keys, spread_join
from twinledger.runtime import land, spread

#: slots of the token count table: its size, and so the broadcast, is the same for any input
SLOTS = 1 << 20
#: from this size on longer prefixes are used, of this share of the set more than the threshold takes
LEVEL_SIZE, LEVEL_SHARE = 256, 0.15
#: tokens that a task handles at once
BATCH_TOKENS = 2_000_000
#: members of a class from which on its pairs are made by several tasks
CLASS_LEAST = 1_000
#: tokens of the sets whose signatures a task compares; signatures are about as many
TASK_SIGNATURES = 4_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Join:
    """threshold: least Jaccard similarity. shared: the k above. block_rows: a token pair that more groups than these may have is
    spread over several tasks, each of which compares two blocks at most."""

    threshold: float
    shared: int = 6
    block_rows: int = 10_000

    def level(self, size: np.ndarray) -> np.ndarray:
        """0 up to LEVEL_SIZE, and one more for each doubling."""
        return np.ceil(np.log2(np.maximum(size, LEVEL_SIZE) / LEVEL_SIZE) - 1e-9).astype(np.int64)

    def shared_at(self, level: int) -> int:
        """The k for pairs whose larger set is of a level: it grows with the sets, so that their signatures grow as their tokens do, not as
        the square. Any such pair has so many tokens in common."""
        least = LEVEL_SIZE << max(0, level - 1)
        return self.shared if level == 0 else max(self.shared, int(min(LEVEL_SHARE, self.threshold) * least))

    @property
    def small(self) -> int:
        """Sets up to this size may have fewer than ``shared`` tokens in common with a similar set, so single tokens find them."""
        return int((self.shared - 1) / self.threshold + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(29))


def _sums(values: np.ndarray, starts: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    return np.add.reduceat(values if mask is None else np.where(mask, values, np.uint64(0)), starts)


class _Ordered:
    """A batch of sets as flat arrays, each set's tokens with rare ones first."""

    def __init__(self, batch: pa.RecordBatch, counts: np.ndarray):
        lists = batch.column(1)
        self.ids = batch.column(0).to_numpy()
        self.size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        token = lists.flatten().to_numpy().view(np.uint64)
        doc = np.repeat(np.arange(len(self.size)), self.size)
        often = counts[(token % np.uint64(SLOTS)).astype(np.int64)]
        order = np.lexsort((token, often, doc))
        self.doc, self.token, self.often = doc, token[order], often[order]
        self.start = np.r_[0, np.cumsum(self.size)[:-1]]
        self.at = np.arange(len(doc)) - np.repeat(self.start, self.size)

    def in_prefix(self, join: Join, shared: int) -> np.ndarray:
        required = np.ceil(join.threshold * self.size - 1e-9).astype(np.int64)
        return self.at < (self.size - required + shared)[self.doc]

    def sketch(self, words: int) -> list[np.ndarray]:
        """Parity of the tokens by bit: the bits in which two sketches differ are at most the tokens in which the sets do."""
        mixed = _mix(self.token * _A)
        bit = np.uint64(1) << ((mixed >> np.uint64(8)) & np.uint64(63))
        word = (mixed >> np.uint64(20)) % np.uint64(words)
        return [np.bitwise_xor.reduceat(np.where(word == np.uint64(w), bit, np.uint64(0)), self.start) for w in range(words)]

    def group(self, join: Join) -> np.ndarray:
        """A key of size and prefix."""
        own = _sums(_mix(self.token + _C), self.start, self.in_prefix(join, join.shared))
        return _mix(own + self.size.astype(np.uint64) * _A)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


WORDS = 4
DOC_COLUMNS = ["id", "size", "grp", "set_a", "set_b", *(f"s{w}" for w in range(WORDS))]


def _described(x: _Ordered, join: Join, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each set of a batch (its DOC_COLUMNS but the id) as four rows of SIGNATURES under its id, with sizes -1 to -4 to know them by.

    So sets are read and tokenised once for both, and the description of a set takes the way of its signatures.
    """
    words = [w.view(np.int64) for w in x.sketch(WORDS)]
    set_a, set_b = (_sums(v, x.start).view(np.int64) for v in (_mix(x.token), _mix(x.token ^ _C) * _A))
    left = np.stack([group.view(np.int64), set_b, words[1], words[3]], axis=1)
    right = np.stack([set_a, words[0], words[2], x.size], axis=1)
    return np.repeat(x.ids, 4), left.ravel(), right.ravel(), np.tile(np.array([-1, -2, -3, -4], np.int32), len(x.ids))


def _descriptions(sig, left, right, size) -> pa.RecordBatch:
    """_described undone: rows of FOUND with the DOC_COLUMNS."""
    order = np.lexsort((-size, sig))
    ids, left, right = sig[order][::4], left[order].reshape(-1, 4), right[order].reshape(-1, 4)
    columns = [ids, right[:, 3], left[:, 0], right[:, 0], left[:, 1], right[:, 1], left[:, 2], right[:, 2], left[:, 3]]
    none = pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["a", "b", *DOC_COLUMNS])


def _parts(batch: pa.RecordBatch):
    """A batch in parts of about BATCH_TOKENS, at least a set each."""
    offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
    ends, at, before = offsets[1:], 0, int(offsets[0])
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, before + BATCH_TOKENS, side="right")))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


SIGNATURES = "sig long, grp long, sketch long, size int"


def _keys(batches, join: Join, counts, above: int = 0):
    """Of each part of the batches: the ordered sets, their groups and sketches, and (signature, set, sets that may have it) of the sets that
    give signatures: the pairs of prefix tokens of one class, and single tokens where sets are small. Copies within a part give them once.
    above: only signatures of tokens that more sets may have."""
    for part in (part for whole in batches for part in _parts(whole)):
        x = _Ordered(part, counts)
        group, (sketch,) = x.group(join), x.sketch(1)
        described = _described(x, join, group)
        _, first = np.unique(np.stack([described[1][::4], described[1][1::4], described[2][::4], described[2][3::4]]), axis=1, return_index=True)  # group, both sums, size
        chosen = np.zeros(len(group), bool)
        chosen[first] = True
        yield x, group, sketch, described, (*_pairs(x, join, chosen, above), *_singles(x, join, chosen, above))


def _signature_slots(join: Join, counts, above: int) -> Callable:
    """(slot, n): how many signatures, of those that more than ``above`` sets may have by their tokens, fall into each of SLOTS slots."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for *_, keys in _keys(batches, join, counts.value, above):
            for sig, *_ in keys:
                total += np.bincount((sig & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["slot", "n"])

    return run


def _signatures(join: Join, counts, slots, block_rows: int) -> Callable:
    """Rows of SIGNATURES, see _keys, those of slots with more than block_rows spread over blocks; and the description of each set."""

    def run(batches):
        for x, group, sketch, described, keys in _keys(batches, join, counts.value):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, described)), ["sig", "grp", "sketch", "size"])
            for sig, doc, often in keys:
                sig, doc = _spread(sig, doc, often, slots.value, group, block_rows)
                yield pa.RecordBatch.from_arrays([_signed(sig), _signed(group[doc]), _signed(sketch[doc]), pa.array(x.size[doc].astype(np.int32))], ["sig", "grp", "sketch", "size"])

    return run


def _pairs(x: _Ordered, join: Join, chosen: np.ndarray, above: int):
    """(signature, set, sets that may have it), for each level that a set, or a similar larger one, is of."""
    wanted = chosen & (x.size > join.small)
    low, high = join.level(x.size), join.level(np.floor(x.size / join.threshold + 1e-9))
    for level in range(int(low.min()), int(high.max()) + 1):
        own = wanted & (low <= level) & (level <= high)
        if own.any():
            shared = join.shared_at(level)
            yield from _pairs_at(x, x.in_prefix(join, shared) & own[x.doc] & (x.often > above), max(1, shared - 1), np.array([level], np.uint64) * _C)


def _pairs_at(x: _Ordered, keep: np.ndarray, classes: int, salt: np.ndarray):
    token, doc, often = x.token[keep], x.doc[keep], x.often[keep]
    kind = (_mix(token ^ _B) % np.uint64(classes)).astype(np.int64)
    key = doc * classes + kind
    order = np.argsort(key, kind="stable")
    token, doc, often, key = token[order], doc[order], often[order], key[order]
    live, step = np.arange(len(key)), 1
    while True:
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        if not len(live):
            return
        a, b = token[live], token[live + step]
        yield _mix(a * _A + _mix(b + _C) + salt), doc[live], np.minimum(often[live], often[live + step])
        step += 1


def _singles(x: _Ordered, join: Join, chosen: np.ndarray, above: int):
    if join.small < 1:
        return
    fits = x.size <= join.small / join.threshold + 1e-9
    keep = x.in_prefix(join, 1) & (chosen & fits)[x.doc] & (x.often > above)
    if keep.any():
        yield _mix(x.token[keep] ^ _A), x.doc[keep], x.often[keep]


def _spread(sig: np.ndarray, doc: np.ndarray, often: np.ndarray, slots: np.ndarray, group: np.ndarray, block_rows: int):
    """Signatures that more than block_rows sets may have, by their tokens and by their slot, repeated for each pair of blocks that their group's block is part of."""
    blocks = -(-np.minimum(often, slots[(sig & np.uint64(SLOTS - 1)).astype(np.int64)]) // block_rows)
    if (blocks <= 1).all():
        return sig, doc
    sigs, docs = [sig[blocks <= 1]], [doc[blocks <= 1]]
    for n in np.unique(blocks[blocks > 1]).tolist():
        s, d = sig[blocks == n], doc[blocks == n]
        mine = group[d] % np.uint64(n)
        for other in range(n):
            o = np.uint64(other)
            lo, hi = np.minimum(mine, o), np.maximum(mine, o)
            sigs.append(_mix(s + lo * _A + hi * _C + np.uint64(1)))
            docs.append(d)
    return np.concatenate(sigs), np.concatenate(docs)


FOUND = "a long, b long, " + ", ".join(f"{c} long" for c in DOC_COLUMNS)


def _required(t: float, total: np.ndarray) -> np.ndarray:
    return np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)


def _unique(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    a, b = (np.concatenate(p) for p in zip(*found))
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)


def _candidates(join: Join, buffer_rows: int = 400_000, hit_rows: int = 500_000) -> Callable:
    """Of a stream of signatures sorted by (sig, size, grp): pairs of groups, smaller key first, that sizes and sketches don't rule out, and
    apart from them the descriptions of sets; rows of FOUND. Pairs leave the task whenever it holds hit_rows of them."""

    def both(sig, grp, sketch, size):
        of_set = size < 0
        if of_set.any():
            yield _descriptions(sig[of_set], grp[of_set], sketch[of_set], size[of_set])
        keep = ~of_set
        if keep.any():
            for pairs in of(sig[keep], grp[keep], sketch[keep], size[keep]):
                none = pa.nulls(pairs.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *[none] * len(DOC_COLUMNS)], ["a", "b", *DOC_COLUMNS])

    def of(sig, grp, sketch, size):
        same = np.zeros(len(sig), bool)
        same[1:] = (sig[1:] == sig[:-1]) & (grp[1:] == grp[:-1])
        fresh = np.flatnonzero(~same)
        # a group whose members differ in their sketches (equal prefixes, other rest) is not ruled out by one
        several = np.zeros(len(sig), bool)
        several[1:] = same[1:] & (sketch[1:] != sketch[:-1])
        mixed = np.bitwise_or.reduceat(several, fresh) if len(fresh) else several
        sig, grp, sketch, size = sig[fresh], grp[fresh], sketch[fresh], size[fresh]
        live, step, found, held = np.arange(len(sig)), 1, [], 0
        while True:
            live = live[live + step < len(sig)]
            live = live[sig[live] == sig[live + step]]
            # sizes grow within a run, so a set that is too small for this one is too small for all after it
            live = live[size[live] >= _required(join.threshold, size[live] + size[live + step])]
            if not len(live):
                break
            other = live + step
            total = size[live] + size[other]
            differ = np.bitwise_count((sketch[live] ^ sketch[other]).view(np.uint64)).astype(np.int64)  # of signed numbers it counts the absolute value
            good = (differ <= total - 2 * _required(join.threshold, total)) | mixed[live] | mixed[other]
            found.append((grp[live[good]], grp[other[good]]))
            held += int(good.sum())
            step += 1
            if held >= hit_rows:
                yield _unique(found)
                found, held = [], 0
        if held:
            yield _unique(found)

    def run(batches):
        kept: list[np.ndarray] | None = None
        waiting: list[list[np.ndarray]] = []
        n = 0

        def joined():
            parts = ([kept] if kept else []) + waiting
            return [np.concatenate(c) for c in zip(*parts)]

        for batch in batches:
            waiting.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.int64)])
            n += batch.num_rows
            if n >= buffer_rows:
                columns = joined()
                whole = int(np.searchsorted(columns[0], columns[0][-1]))
                waiting, n = [], 0
                kept = [c[whole:] for c in columns]
                if whole:
                    yield from both(*(c[:whole] for c in columns))
        if kept or waiting:
            yield from both(*joined())

    return run


def _slot_table(slots: DataFrame) -> np.ndarray:
    """(slot, n) as an array of SLOTS numbers, whatever the input."""
    counts = np.zeros(SLOTS, np.int64)
    got = slots.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return counts


def token_counts(sets: DataFrame) -> np.ndarray:
    """How many sets have a token of each slot."""
    return _slot_table(sets.select(F.explode("tokens").alias("t")).select((F.col("t").bitwiseAND(F.lit(SLOTS - 1))).cast("int").alias("slot"), F.lit(1).alias("n")))


@dataclass(frozen=True)
class Similar:
    """pairs: (a, b) of class representatives, smaller first, with similarity. members: (id, rep) of every set that was joined."""

    pairs: DataFrame
    members: DataFrame


def _some(ids: DataFrame, column: str) -> Callable[[DataFrame, Column], DataFrame]:
    """Keeps the rows whose id may be among ids, by a table of at most SLOTS hash values; join afterwards for exactness."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    known = F.broadcast(ids.select(slot(F.col(column)).alias("__slot")).distinct())
    return lambda df, c: df.withColumn("__slot", slot(c)).join(known, "__slot", "left_semi").drop("__slot")


def similar_sets(source: DataFrame, sets_of: Callable[[DataFrame], DataFrame], join: Join) -> Similar:
    """All pairs of sets with similarity >= join.threshold.

    source: a scan (see runtime.spread) of rows with a unique id; sets_of turns such rows into (id long, tokens array<long>), the tokens distinct 64-bit hashes, and
    may leave rows out. The sets are made once and written, as four passes read them. Rows without a set (null) and empty
    sets are similar to none and are in neither result. Equal sets are one class, represented by its smallest id; pairs of a class
    with itself aren't listed, they follow from members. An empty input gives empty results.
    """
    spark = source.sparkSession
    sets = land(sets_of(spread(source)).filter(F.size("tokens") > 0).select("id", "tokens"), "sets")
    counts = spark.sparkContext.broadcast(token_counts(sets))

    # a signature is as frequent as its rarer token at most; of those that may be frequent by this it is counted how many there are
    frequent = counts.value.max() > join.block_rows
    slots = _slot_table(sets.mapInArrow(_signature_slots(join, counts, join.block_rows), "slot int, n long")) if frequent else np.zeros(SLOTS, np.int64)
    spread_slots = spark.sparkContext.broadcast(slots)
    block_rows = max(join.block_rows, int(2 * slots.mean()))  # slots that are full evenly tell nothing
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.value.sum()) // TASK_SIGNATURES)
    signatures = sets.mapInArrow(_signatures(join, counts, spread_slots, block_rows), SIGNATURES).repartition(n, "sig").sortWithinPartitions("sig", "size", "grp")
    found = land(signatures.mapInArrow(_candidates(join), FOUND), "found")
    docs, group_pairs = found.filter("id is not null").select(*DOC_COLUMNS), land(found.filter("id is null").select("a", "b").distinct(), "group-pairs")

    of_set = ["set_a", "set_b", "size"]
    classes = docs.groupBy(*of_set).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("grp").alias("grp"), *(F.min(f"s{w}").alias(f"s{w}") for w in range(WORDS)))
    classes = land(classes, "classes")
    # a class with very many copies is one of few; its sets meet its row by broadcast
    hot = hot_keys(docs, of_set)
    members = spread_join(docs.select("id", *of_set), classes.select(*of_set, "rep"), of_set, hot, ["id"]).select("id", "rep")

    def side(key: str, x: str) -> DataFrame:
        return classes.select(F.col("grp").alias(key), F.col("rep").alias(f"rep_{x}"), F.col("size").alias(f"size_{x}"), *(F.col(f"s{w}").alias(f"s{w}_{x}") for w in range(WORDS)))

    one, two = side("a", "a"), side("b", "b")
    across = spread_join(group_pairs, one, ["a"], hot_keys(group_pairs, ["a"]), ["b"])
    across = spread_join(across, two, ["b"], hot_keys(group_pairs, ["b"]), ["a", "rep_a"])
    crowded = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("grp").alias("a"))
    within = one.join(crowded, "a", "left_semi")
    within = spread_join(within.withColumn("b", F.col("a")), two, ["b"], _renamed(hot_keys(classes, ["grp"], least=CLASS_LEAST), grp="b"), ["rep_a"]).filter("rep_a < rep_b")
    need = F.ceil(F.lit(join.threshold / (1 + join.threshold)) * (F.col("size_a") + F.col("size_b")) - F.lit(1e-9))
    differ = sum((F.bit_count(F.col(f"s{w}_a").bitwiseXOR(F.col(f"s{w}_b"))) for w in range(WORDS)), F.lit(0))
    likely = across.drop("a", "b").unionByName(within.drop("a", "b")).filter((F.least("size_a", "size_b") >= need) & (differ <= F.col("size_a") + F.col("size_b") - 2 * need))
    likely = land(likely.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")), "likely")

    ends = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id")))
    wanted = _some(ends, "id")(sets, F.col("id")).join(ends.distinct(), "id", "left_semi")
    left = spread_join(likely, wanted.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a")), ["a"], hot_keys(likely, ["a"]), ["b"])
    both = spread_join(left, wanted.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b")), ["b"], hot_keys(likely, ["b"]), ["a"])
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
    scored = both.select("a", "b", overlap.alias("common"), (F.size("tokens_a") + F.size("tokens_b") - overlap).alias("either"))
    pairs = scored.filter(F.col("common") >= F.lit(join.threshold) * F.col("either") - F.lit(1e-9)).select("a", "b", (F.col("common") / F.col("either")).alias("similarity"))
    return Similar(pairs, members)


def _renamed(hot: DataFrame | None, **names: str) -> DataFrame | None:
    return None if hot is None else hot.withColumnsRenamed(names)


def _table(df: DataFrame, name: str) -> DataFrame:
    """df, landed unless it is a landed table already."""
    return df if hasattr(df, "landed_at") else land(df, name)


def row_pairs(found: Similar) -> DataFrame:
    """(a, b) of ids, smaller first: pairs of classes expanded to their members, and the pairs within each class.

    All pairs of a large class are many by definition (links gives the same knowledge in one row per set); they are made by tasks that each hold
    a part of its members against the class, so no task makes all of them.
    """
    members, pairs = _table(found.members, "members"), _table(found.pairs, "pairs").select("a", "b")
    x = members.select(F.col("rep").alias("a"), F.col("id").alias("id_a"))
    y = members.select(F.col("rep").alias("b"), F.col("id").alias("id_b"))
    large = hot_keys(members, ["rep"], least=CLASS_LEAST)
    # the smaller side of each join is repeated for the parts of a large class
    across = spread_join(x.join(pairs.select("a").distinct(), "a", "left_semi"), pairs, ["a"], _renamed(large, rep="a"), ["id_a"])
    across = spread_join(across, y, ["b"], _first_of(hot_keys(pairs, ["b"], least=CLASS_LEAST), _renamed(large, rep="b")), ["id_a"]).select("id_a", "id_b")
    copies = x.filter("id_a <> a").select("a").distinct()
    own = x.join(copies, "a", "left_semi").withColumn("b", F.col("a"))
    within = spread_join(own, y, ["b"], _renamed(large, rep="b"), ["id_a"]).filter("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def _first_of(*hot: DataFrame | None) -> DataFrame | None:
    """Hot keys of several lists, each with the most parts that one of them gives."""
    given = [h for h in hot if h is not None]
    if not given:
        return None
    keys = [c for c in given[0].columns if c != "__parts"]
    return reduce(DataFrame.unionByName, given).groupBy(*keys).agg(F.max("__parts").alias("__parts"))


def links(found: Similar) -> DataFrame:
    """(id, class_id, copies, links) of every set: its class, the sets of that class, and how many other sets are similar to it, copies
    included; from counts per class, without expanding pairs."""
    members = _table(found.members, "members")
    sizes = land(members.groupBy(F.col("rep").alias("class_id")).agg(F.count(F.lit(1)).alias("copies")), "sizes")
    ends = found.pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    ends = land(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))), "ends")
    reached = spread_join(ends, sizes.select(F.col("class_id").alias("v"), "copies"), ["v"], hot_keys(ends, ["v"]), ["u"]).groupBy(F.col("u").alias("class_id")).agg(F.sum("copies").alias("others"))
    per_class = sizes.join(reached, "class_id", "left").select("class_id", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return spread_join(members.withColumnRenamed("rep", "class_id"), per_class, ["class_id"], _renamed(hot_keys(members, ["rep"]), rep="class_id"), ["id"]).select("id", "class_id", "copies", "links")
