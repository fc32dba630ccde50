"""Token movements: cleaning, time-ordered facts and joins by nearness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.identity import tidy_address, tidy_chain

CONTRACT = ["chain", "contract_address"]
EVENT = [*CONTRACT, "tx_hash", "token_id", "from_address", "to_address"]
#: fixed value: where tokens come from when they are made
ZERO = "0x" + "0" * 40


def movements(transfers: DataFrame) -> DataFrame:
    """Transfers with tidied chain, contract and addresses, each event once: of repeated rows the one that arrived first.

    Rows without a contract are dropped; blank addresses are null. Nulls in the key of an event count as equal.
    """
    tidy = transfers.withColumns({
        "chain": tidy_chain(F.col("chain")),
        **{c: tidy_address(F.col("chain"), F.col(c)) for c in ("contract_address", "from_address", "to_address", "fee_payer", "mint_payment_receiver")},
        "tx_hash": tidy_address(F.col("chain"), F.col("tx_hash")),
    }).filter(F.col("contract_address").isNotNull() & F.col("chain").isNotNull())
    rest = [c for c in tidy.columns if c not in EVENT]
    first = F.min(F.struct(F.col("ingested_at").isNull().alias("__late"), "ingested_at", *(c for c in rest if c != "ingested_at")))
    return tidy.groupBy(*EVENT).agg(first.alias("f")).select(*EVENT, *(F.col(f"f.{c}") for c in rest))


def lifecycles(moved: DataFrame) -> DataFrame:
    """Per contract: first and last activity, first mint, first transfer between holders, and how many events, tokens and mints there are."""
    minted = F.coalesce("is_mint", F.lit(False))
    per_token = moved.groupBy(*CONTRACT, "token_id").agg(
        F.count(F.lit(1)).alias("e"), F.count(F.when(minted, 1)).alias("m"), F.min("block_ts").alias("lo"), F.max("block_ts").alias("hi"), F.min(F.when(minted, F.col("block_ts"))).alias("fm"), F.min(F.when(~minted, F.col("block_ts"))).alias("ft")
    )
    return per_token.groupBy(*CONTRACT).agg(F.sum("e").alias("events"), F.count("token_id").alias("tokens"), F.sum("m").alias("mints"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"), F.min("fm").alias("first_mint_at"), F.min("ft").alias("first_transfer_at"))


def holders(moved: DataFrame) -> DataFrame:
    """(contract, token_id, owner, since): who got each token last, by time and then by block and transaction; events of unknown time come first."""
    last = F.max(F.struct("block_ts", "block_number", "tx_hash", "to_address"))
    return moved.filter(F.col("token_id").isNotNull() & F.col("to_address").isNotNull()).groupBy(*CONTRACT, "token_id").agg(last.alias("l")).select(*CONTRACT, "token_id", F.col("l.to_address").alias("owner"), F.col("l.block_ts").alias("since"))


def first_disposals(moved: DataFrame) -> DataFrame:
    """(contract, token_id, address, acquired_at, disposed_at): for each receipt the first strictly later sending of that token by that address; null if none.

    A window per token and address: such a group holds the moves of one token, however large its contract is.
    """
    timed = moved.filter(F.col("block_ts").isNotNull() & F.col("token_id").isNotNull())
    got = timed.select(*CONTRACT, "token_id", F.col("to_address").alias("address"), "block_ts", F.lit(True).alias("got"))
    gave = timed.select(*CONTRACT, "token_id", F.col("from_address").alias("address"), "block_ts", F.lit(False).alias("got"))
    both = got.unionByName(gave).filter(F.col("address").isNotNull()).withColumn("us", F.unix_micros(F.col("block_ts").cast("timestamp")))
    later = Window.partitionBy(*CONTRACT, "token_id", "address").orderBy("us").rangeBetween(1, Window.unboundedFollowing)
    found = both.withColumn("disposed_at", F.min(F.when(~F.col("got"), F.col("block_ts"))).over(later)).filter("got")
    return found.select(*CONTRACT, "token_id", "address", F.col("block_ts").alias("acquired_at"), "disposed_at")


def paid_and_held(moved: DataFrame) -> DataFrame:
    """(contract, address, token_id): mints that someone paid for (a native or USD amount above 0) whose receiver still holds the token."""
    paid = (F.coalesce("mint_payment_native", F.lit(0.0)) > 0) | (F.coalesce("mint_payment_usd", F.lit(0.0)) > 0)
    bought = moved.filter(F.coalesce("is_mint", F.lit(False)) & paid).select(*CONTRACT, F.col("to_address").alias("address"), "token_id").distinct()
    held = holders(moved).select(*CONTRACT, F.col("owner").alias("address"), "token_id")
    return bought.join(held, [*CONTRACT, "address", "token_id"], "left_semi")


def transaction_gas(moved: DataFrame) -> DataFrame:
    """(chain, tx_hash, gas_native, fee_payer, events): one row per transaction; the highest gas and smallest payer that its events name."""
    return moved.filter(F.col("tx_hash").isNotNull()).groupBy("chain", "tx_hash").agg(F.max("gas_native").alias("gas_native"), F.min("fee_payer").alias("fee_payer"), F.count(F.lit(1)).alias("events"))


def mint_payments(moved: DataFrame) -> DataFrame:
    """(chain, tx_hash, buyer, mints, paid_native, receiver): payments of a transaction's mints by buyer; receiver only if all name the same one."""
    minted = moved.filter(F.coalesce("is_mint", F.lit(False)) & F.col("tx_hash").isNotNull())
    return minted.groupBy("chain", "tx_hash", F.col("to_address").alias("buyer")).agg(
        F.count(F.lit(1)).alias("mints"), F.sum("mint_payment_native").alias("paid_native"),
        F.when(F.min("mint_payment_receiver") == F.max("mint_payment_receiver"), F.min("mint_payment_receiver")).alias("receiver"),
    )


def nearest_outside(windows: DataFrame, events: DataFrame, key: str, within: int) -> DataFrame:
    """(windows' columns, before, after): for each window (key, first, last) the nearest event of its key outside of it, at most ``within`` away.

    before: the highest ``at`` in [first - within, first); after: the lowest in (last, last + within]; null if none. A range join over
    buckets of ``within``: a window reaches into two buckets on either side, so a key with very many events spreads over its buckets.
    """
    keyed = windows.withColumn("__w", F.struct(*windows.columns))
    spans = F.array_distinct(F.array(*(F.floor(F.expr(e) / within) for e in (f"first - {within}", "first - 1", "last + 1", f"last + {within}"))))
    probes = keyed.select("__w", F.col(key), "first", "last", F.explode(spans).alias("__b"))
    near = events.filter(F.col("at").isNotNull()).select(key, "at", F.floor(F.col("at") / within).alias("__b"))
    hit = probes.join(near, [key, "__b"]).filter(((F.col("at") < F.col("first")) & (F.col("at") >= F.col("first") - within)) | ((F.col("at") > F.col("last")) & (F.col("at") <= F.col("last") + within)))
    found = hit.groupBy("__w").agg(F.max(F.when(F.col("at") < F.col("first"), F.col("at"))).alias("before"), F.min(F.when(F.col("at") > F.col("last"), F.col("at"))).alias("after"))
    return keyed.join(found, "__w", "left").select(*windows.columns, "before", "after")


def with_receipts(moved: DataFrame, receipts: DataFrame) -> DataFrame:
    """Moves with the gas and payer of their transaction's receipt (tx_hash, gas_native, fee_payer) where the move names none itself.

    Receipts join by lower-cased hash; of several with one hash the highest gas and smallest payer count. A receipt serves all moves
    of its transaction, so gas must be counted by transaction (see transaction_gas).
    """
    known = receipts.filter("tx_hash is not null").groupBy(F.lower(F.trim("tx_hash")).alias("__tx")).agg(F.max("gas_native").alias("__gas"), F.min("fee_payer").alias("__payer"))
    joined = moved.withColumn("__tx", F.lower("tx_hash")).join(known, "__tx", "left")
    return joined.withColumns({"gas_native": F.coalesce("gas_native", "__gas"), "fee_payer": F.coalesce("fee_payer", "__payer")}).select(*moved.columns)
