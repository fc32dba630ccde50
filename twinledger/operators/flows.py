"""Movements of value beside those of tokens: which touch a set of addresses, what they paid for, and facts about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.identity import tidy_address, tidy_chain

EVENT = ["chain", "tx_hash", "event_id", "from_address", "to_address"]


def tidy_flows(flows: DataFrame) -> DataFrame:
    """Flows (chain, tx_hash, event_id, from_address, to_address, amount, ...) with tidied chain, hash and addresses; without a hash, an end, or between one address and itself they are left out."""
    tidy = flows.withColumns({c: tidy_address(F.col("chain"), F.col(c)) for c in ("tx_hash", "from_address", "to_address")}).withColumn("chain", tidy_chain(F.col("chain")))
    return tidy.filter("chain is not null and tx_hash is not null and from_address is not null and to_address is not null and from_address <> to_address")


def classified(flows: DataFrame, operators: DataFrame) -> DataFrame:
    """Flows with ``kind``: funding if only the receiver is an operator (chain, address), withdrawal if only the sender is, revenue_backflow if both are;
    others are left out.

    Operators are joined as keys, twice, so there may be any number of them; repeated ones count once. A flow with a null end has no kind.
    """
    known = operators.select("chain", "address").filter("address is not null").distinct()
    side = lambda c: known.select("chain", F.col("address").alias(c), F.lit(True).alias(f"__{c}"))
    both = flows.join(side("from_address"), ["chain", "from_address"], "left").join(side("to_address"), ["chain", "to_address"], "left")
    sends, gets = F.coalesce("__from_address", F.lit(False)), F.coalesce("__to_address", F.lit(False))
    kind = F.when(sends & gets, "revenue_backflow").when(gets, "funding").when(sends, "withdrawal")
    return both.withColumn("kind", kind).filter("kind is not null and from_address <> to_address").select(*flows.columns, "kind")


def merged(flows: DataFrame) -> DataFrame:
    """(EVENT, amount, kind): each flow once, as several reports may hold it: the highest known amount, and of its kinds revenue_backflow if any says so or
    some say funding and others withdrawal, else the one they agree on. A null event_id is an id of its own; null amounts don't count."""
    has = lambda k: F.bool_or(F.col("kind") == k)
    once = flows.groupBy(*EVENT).agg(F.max("amount").alias("amount"), has("revenue_backflow").alias("b"), has("funding").alias("f"), has("withdrawal").alias("w"))
    kind = F.when(F.col("b") | (F.col("f") & F.col("w")), "revenue_backflow").when(F.col("f"), "funding").otherwise("withdrawal")
    return once.select(*EVENT, "amount", kind.alias("kind"))


def in_window(flows: DataFrame, spans: DataFrame, within: int) -> DataFrame:
    """Flows with an ``at`` that lie in the span (chain, first, last) of their chain or at most ``within`` before or after it. One span per chain; a null at is out."""
    joined = flows.join(F.broadcast(spans.select("chain", "first", "last")), "chain")
    return joined.filter((F.col("at") >= F.col("first") - within) & (F.col("at") <= F.col("last") + within)).select(*flows.columns)


def mint_outflows(moved: DataFrame, flows: DataFrame) -> DataFrame:
    """(chain, tx_hash, buyer, mints, paid, receiver, paid_each): what the receiver of mints sent in the same transaction, if it sent to exactly one other address.

    Mints and flows are both aggregated by (chain, tx_hash, address) before they are joined, so a transaction with very many of either is one row.
    """
    minted = moved.filter(F.coalesce("is_mint", F.lit(False)) & F.col("tx_hash").isNotNull() & F.col("to_address").isNotNull())
    mints = minted.groupBy("chain", "tx_hash", F.col("to_address").alias("buyer")).agg(F.count(F.lit(1)).alias("mints"))
    sent = flows.filter("amount > 0").groupBy("chain", "tx_hash", F.col("from_address").alias("buyer")).agg(F.sum("amount").alias("paid"), F.min("to_address").alias("lo"), F.max("to_address").alias("hi"))
    joined = mints.join(sent.filter("lo = hi and lo <> buyer"), ["chain", "tx_hash", "buyer"])
    return joined.select("chain", "tx_hash", "buyer", "mints", "paid", F.col("lo").alias("receiver"), (F.col("paid") / F.col("mints")).alias("paid_each"))


def with_mint_payments(moved: DataFrame, flows: DataFrame) -> DataFrame:
    """Moves with mint_payment_native and mint_payment_receiver of mints taken from the higher of what they name themselves, which is for their
    whole transaction, and what mint_outflows finds, divided by the mints of the buyer in the transaction; null where neither is known."""
    key = ["chain", "tx_hash", "to_address"]
    minted = F.coalesce("is_mint", F.lit(False))
    count = moved.filter(minted).groupBy(*key).agg(F.count(F.lit(1)).alias("__mints"))
    paid = mint_outflows(moved, flows).select("chain", "tx_hash", F.col("buyer").alias("to_address"), F.struct(F.col("paid").alias("p"), F.col("receiver").alias("r")).alias("__flow"))
    joined = moved.join(count, key, "left").join(paid, key, "left")
    own = F.when((F.col("mint_payment_native") > 0) & F.col("mint_payment_receiver").isNotNull(), F.struct(F.col("mint_payment_native").alias("p"), F.col("mint_payment_receiver").alias("r")))
    best = F.greatest(own, F.col("__flow"))
    out = {"mint_payment_native": F.when(minted, best["p"] / F.coalesce("__mints", F.lit(1))), "mint_payment_receiver": F.when(minted, best["r"])}
    return joined.withColumn("__best", best).withColumns({c: F.when(F.col("__best").isNotNull(), v) for c, v in out.items()}).select(*moved.columns)


def facts(moved: DataFrame, flows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mints, transfers, nfts, addresses, flows_in, receiver, receiver_amount, receiver_share): per key how many moves, tokens and addresses there
    are, the sum of its flows, and the address that got most of it; ties go to the smaller address.

    Zero addresses and null ones are none. Tokens and addresses are made distinct before they are counted; the argmax is a minimum over
    (amount descending, address), so no key's receivers meet in one task. flows: (keys, to_address, amount).
    """
    from twinledger.operators.events import ZERO

    minted = F.coalesce("is_mint", F.lit(False))
    moves = moved.groupBy(*keys).agg(F.count(F.when(minted, 1)).alias("mints"), F.count(F.when(~minted, 1)).alias("transfers"))
    distinct = lambda df, name: df.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    nfts = distinct(moved.filter("token_id <> ''").select(*keys, "token_id"), "nfts")
    ends = moved.select(*keys, F.explode(F.array("from_address", "to_address")).alias("a")).filter((F.col("a") != "") & (F.col("a") != ZERO))
    got = flows.filter("amount > 0 and to_address is not null").groupBy(*keys, "to_address").agg(F.sum("amount").alias("amount"))
    best = got.groupBy(*keys).agg(F.sum("amount").alias("flows_in"), F.min(F.struct((-F.col("amount")).alias("m"), F.col("to_address").alias("a"))).alias("b"))
    best = best.select(*keys, "flows_in", F.col("b.a").alias("receiver"), (-F.col("b.m")).alias("receiver_amount"), (-F.col("b.m") / F.col("flows_in")).alias("receiver_share"))
    out = moves.join(nfts, keys, "left").join(distinct(ends, "addresses"), keys, "left").join(best, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("nfts", "addresses")})


def shared_controllers(seeds: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seed_chain, seed_address, candidate_chain, candidate_address, controllers): pairs of contracts with a controller (chain, contract_address, controller) in
    common, all of these sorted. Controllers are tidied; blank ones are none. Only given pairs are looked at, none are made."""
    tidy = lambda df: df.select("chain", "contract_address", tidy_address(F.col("chain"), F.col("controller")).alias("controller")).filter("controller is not null").distinct()
    side = lambda df, x: tidy(df).select(F.col("chain").alias(f"{x}_chain"), F.col("contract_address").alias(f"{x}_address"), "controller")
    on = ["seed_chain", "seed_address", "candidate_chain", "candidate_address"]
    met = pairs.select(*on).distinct().join(side(seeds, "seed"), on[:2]).join(side(candidates, "candidate"), [*on[2:], "controller"])
    return met.groupBy(*on).agg(F.array_join(F.sort_array(F.collect_set("controller")), ",").alias("controllers"))


def controllers_of(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(chain, contract_address, controller, fields): the addresses that a contract's fields name as its controllers, each once with the sorted names of
    the fields; fields in one of the forms that contracts answer (an address, or 32 bytes with it at the end). Zero and malformed ones are none."""
    from twinledger.operators.events import ZERO

    def address(c: str) -> Column:
        value = F.lower(F.trim(c))
        return F.when(value.rlike("^0x0{24}[0-9a-f]{40}$"), F.concat(F.lit("0x"), F.substring(value, -40, 40))).otherwise(tidy_address(F.col("chain"), F.col(c)))

    each = rows.select("chain", "contract_address", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), address(c).alias("a")) for c in fields))).alias("x"))
    found = each.filter((F.col("x.a") != ZERO) & ((F.col("chain") == "solana") | F.col("x.a").rlike("^0x[0-9a-f]{40}$")))
    return found.groupBy("chain", "contract_address", F.col("x.a").alias("controller")).agg(F.array_join(F.sort_array(F.collect_set("x.field")), ",").alias("fields"))
