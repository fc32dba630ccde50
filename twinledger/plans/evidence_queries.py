"""Queries over stored replies, value flows and states of evidence, and SQL that gives the same rows.

The test tables hold no replies, so the queries write those that a provider would give for the transfers, and read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions import decode, text
from twinledger.operators import events, evidence, flows, graph
from twinledger.plans.snapshot_queries import _address, _MOVES
from twinledger.runtime import land, table
from twinledger.sources import providers


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Transfers as they are, with a hexadecimal block and a written time."""
    t = table(spark, d, "transfers").filter("chain is not null and contract_address is not null")
    return t.withColumns({"block_hex": F.concat(F.lit("0x"), F.hex("block_number")), "iso": F.date_format("block_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")})


def _pages(rows: DataFrame, payload, *keys: str) -> DataFrame:
    """One reply for each row, as JSON text."""
    return rows.select(*(keys or ("chain", "contract_address")), F.to_json(payload).alias("payload"))


def _in(name: str, item, outer: str | None = None):
    """An object with a list of one item under a name, and that under another."""
    one = F.struct(F.array(item).alias(name))
    return F.struct(one.alias(outer)) if outer else one


def reply_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Token moves read from replies that list them."""
    item = F.struct(F.col("tx_hash").alias("hash"), F.col("from_address").alias("from"), F.col("to_address").alias("to"), F.col("token_id").alias("erc721TokenId"), F.col("block_hex").alias("blockNum"), F.struct(F.col("iso").alias("blockTimestamp")).alias("metadata"))
    return providers.transfers(_pages(_raw(spark, d), _in("transfers", item, "result")))


def listed_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Token moves read from an explorer's lists."""
    item = F.struct(F.col("tx_hash").alias("hash"), F.col("from_address").alias("from"), F.col("to_address").alias("to"), F.col("token_id").alias("tokenID"), F.col("block_number").cast("string").alias("blockNumber"), F.unix_seconds(F.col("block_ts").cast("timestamp")).cast("string").alias("timeStamp"))
    return providers.listed_transfers(_pages(_raw(spark, d), _in("result", item)))


def preferred_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Token moves by contract from the first source that has any, minted ones; other contracts from the explorer."""
    first = reply_transfers(spark, d).filter("is_mint")
    key = ["chain", "contract_address"]
    states = lambda df: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, evidence.page_state(F.col("n"), F.lit(False)).alias("state"))
    second = listed_transfers(spark, d)
    found = evidence.first_source([(first, states(first)), (second, states(second))], key)
    return found.groupBy(*key).agg(F.count(F.lit(1)).alias("moves"), F.count(F.when(F.col("is_mint"), 1)).alias("mints"))


def _holders(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("to_address").alias("ownerAddress"), F.array(F.struct(F.col("token_id").alias("tokenId"), F.concat(F.lit("0x"), F.hex("block_number"), F.lit("0" * 20)).alias("balance"))).alias("tokenBalances"))
    return providers.holders(_pages(_raw(spark, d), _in("owners", item)))


def reply_holders(spark: SparkSession, d: str) -> DataFrame:
    """Holders read from replies, with balances beyond 64 bits."""
    return _holders(spark, d).groupBy("chain", "owner").agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("known"), F.max(F.struct(F.length("balance").alias("l"), F.col("balance").alias("b")))["b"].alias("highest"))


def populations(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens a contract has by its holders; unknown where a holder names none or the contract's evidence was cut off, as that of contracts with more than 50 moves."""
    key = ["chain", "contract_address"]
    sizes = _raw(spark, d).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    states = sizes.select(*key, evidence.page_state(F.col("n"), F.col("n") > 50).alias("state"))
    return evidence.population(land(_holders(spark, d), "holders"), states, key)


def reply_sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales read from replies: amounts of fees in one currency, unknown where there are two."""
    fee = lambda amount, symbol: F.struct(amount.cast("string").alias("amount"), symbol.alias("symbol"), F.lit(3).alias("decimals"))
    other = F.when(F.col("is_mint"), F.lit("eth")).otherwise(F.lit("usd"))
    item = F.struct(
        F.col("tx_hash").alias("transactionHash"), F.col("from_address").alias("sellerAddress"), F.col("to_address").alias("buyerAddress"), F.col("token_id").alias("tokenId"), F.col("iso").alias("blockTimestamp"), F.col("block_number").cast("string").alias("blockNumber"),
        F.lit("m").alias("marketplace"), fee(F.concat(F.col("block_number").cast("string"), F.lit("0" * 40)), F.lit("ETH")).alias("sellerFee"), fee(F.col("block_number"), other).alias("royaltyFee"),
    )
    return providers.sales(_pages(_raw(spark, d), _in("nftSales", item))).select("chain", "contract_address", "tx_hash", "token_id", "seller", "buyer", "at", "block_number", "price_raw", F.col("amount").isNotNull().alias("priced"), F.round("royalty_part", 3).alias("royalty_part"))


def market_sales(spark: SparkSession, d: str) -> DataFrame:
    """Sales read from a marketplace's events."""
    payment = F.struct(F.col("block_number").cast("string").alias("quantity"), F.lit(6).alias("decimals"), F.lit("USDC").alias("symbol"))
    party = lambda c: F.struct(F.col(c).alias("address"))
    item = F.struct(F.lit("sale").alias("event_type"), F.col("tx_hash").alias("transaction"), party("from_address").alias("seller"), party("to_address").alias("buyer"), F.col("iso").alias("event_timestamp"), F.struct(F.col("token_id").alias("identifier"), F.trim("contract_address").alias("contract")).alias("nft"), payment.alias("payment"))
    tidy = _raw(spark, d).withColumn("chain", F.lower(F.trim("chain")))
    return providers.market_sales(_pages(tidy, _in("asset_events", item))).select("chain", "contract_address", "tx_hash", "token_id", "seller", "buyer", "at", F.round("amount", 6).alias("amount"), "symbol")


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    payload = F.struct(F.col("block_hex").alias("gasUsed"), F.lit("0x3b9aca00").alias("effectiveGasPrice"), F.col("from_address").alias("from"))
    return providers.receipts(_pages(_raw(spark, d).filter("tx_hash is not null"), payload, "tx_hash"))


def reply_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Gas and payer of each transaction by its receipts."""
    found = _receipts(spark, d).groupBy("tx_hash").agg(F.max("gas_native").alias("gas_native"), F.min("fee_payer").alias("fee_payer"), F.count(F.lit(1)).alias("receipts"))
    return found.withColumn("gas_native", F.round("gas_native", 9))


def gas_by_receipt(spark: SparkSession, d: str) -> DataFrame:
    """Gas of transactions, from receipts where the moves name none."""
    moved = events.with_receipts(events.movements(table(spark, d, "transfers")), _receipts(spark, d))
    return events.transaction_gas(moved).withColumn("gas_native", F.round("gas_native", 9))


def owner_changes(spark: SparkSession, d: str) -> DataFrame:
    """Who gave and who got a token, from token balances before and after a transaction."""
    side = lambda owner, amount, mint: F.struct(F.lit(1).alias("accountIndex") if owner == "from_address" else F.lit(2).alias("accountIndex"), mint.alias("mint"), F.col(owner).alias("owner"), F.struct(F.lit(amount).alias("amount")).alias("uiTokenAmount"))
    m = F.col("token_id")
    post = F.array(side("from_address", "0", m), side("to_address", "1", m))
    pre = F.when(F.col("is_mint"), F.array(side("from_address", "0", m))).otherwise(F.array(side("from_address", "1", m), side("to_address", "7", F.lit("other"))))
    given = _one_move(_raw(spark, d))
    pages = given.select(F.col("tx_hash").alias("signature"), m.alias("mint"), F.to_json(F.struct(F.struct(pre.alias("preTokenBalances"), post.alias("postTokenBalances")).alias("meta"))).alias("payload"))
    return providers.owner_changes(pages)


def _one_move(raw: DataFrame) -> DataFrame:
    """The moves of the transactions and tokens that have only one."""
    given = raw.filter("tx_hash is not null and token_id is not null").withColumn("is_mint", F.coalesce("is_mint", F.lit(False)))
    once = given.groupBy("tx_hash", "token_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return given.join(once, ["tx_hash", "token_id"], "left_semi")


def coin_moves(spark: SparkSession, d: str) -> DataFrame:
    """Coin movements read from parsed transactions, by instruction, or for even blocks by balances."""
    step = F.struct(F.struct(F.lit("transfer").alias("type"), F.struct(F.col("from_address").alias("source"), F.col("to_address").alias("destination"), (F.col("block_number") * 1000).alias("lamports")).alias("info")).alias("parsed"))
    none = F.struct(F.struct(F.lit("vote").alias("type"), F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("destination"), F.lit(None).cast("long").alias("lamports")).alias("info")).alias("parsed"))
    keys = F.array(F.struct(F.col("from_address").alias("pubkey")), F.struct(F.col("to_address").alias("pubkey")))
    odd = F.col("block_number") % 2 == 1
    message = F.struct(keys.alias("accountKeys"), F.when(odd, F.array(none, step)).otherwise(F.array(none)).alias("instructions"))
    meta = F.struct(F.lit(5000).alias("fee"), F.array(F.lit(10**15), F.lit(0)).alias("preBalances"), F.array(F.lit(10**15) - 5000 - F.col("block_number"), F.col("block_number")).alias("postBalances"))
    raw = _raw(spark, d).filter("tx_hash is not null and block_number > 0")
    pages = raw.select(F.col("tx_hash").alias("signature"), F.to_json(F.struct(F.struct(message.alias("message")).alias("transaction"), meta.alias("meta"))).alias("payload"))
    return providers.sol_moves(pages).withColumn("amount", F.round("amount", 9))


def collection_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets of collections, with who may change them."""
    group = F.struct(F.lit("collection").alias("group_key"), F.col("contract_address").alias("group_value"), F.struct(F.concat(F.lit(" "), F.col("chain")).alias("update_authority")).alias("collection_metadata"))
    creators = F.array(F.struct(F.col("symbol").alias("address"), F.lit(True).alias("verified")), F.struct(F.col("token_standard").alias("address"), F.lit(False).alias("verified")))
    item = F.struct(F.col("asset_id").cast("string").alias("id"), (F.col("asset_id") % 5 == 0).alias("burnt"), F.struct(F.col("token_uri").alias("json_uri"), F.struct(F.col("asset_name").alias("name"), F.col("symbol").alias("symbol")).alias("metadata")).alias("content"), F.array(group).alias("grouping"), creators.alias("creators"), F.struct(F.col("image_uri").alias("owner")).alias("ownership"))
    a = table(spark, d, "nft_assets").filter("contract_address is not null")
    return providers.collection_assets(a.select(F.col("contract_address").alias("collection"), F.to_json(_in("items", item, "result")).alias("payload"))).drop("interface")


def _native(spark: SparkSession, d: str) -> DataFrame:
    """Payments of mints as plain transfers of the coin, from the minter to the receiver."""
    item = F.struct(F.lit("external").alias("category"), F.col("tx_hash").alias("hash"), F.concat_ws(":", "tx_hash", "token_id").alias("uniqueId"), F.col("to_address").alias("from"), F.col("mint_payment_receiver").alias("to"), F.col("mint_payment_native").alias("value"), F.col("iso").alias("metadata_time"), F.col("block_hex").alias("blockNum"))
    paid = _raw(spark, d).filter("mint_payment_native is not null and chain <> 'x'").withColumn("chain", F.lower(F.trim("chain")))
    return providers.native_moves(_pages(paid, _in("transfers", item, "result"), "chain"))


def native_moves(spark: SparkSession, d: str) -> DataFrame:
    return _native(spark, d).drop("at").withColumn("amount", F.round("amount", 9))


def _flows(spark: SparkSession, d: str) -> DataFrame:
    """Coin movements: what senders of tokens paid as gas, as if to the receiver."""
    m = events.movements(table(spark, d, "transfers"))
    return flows.tidy_flows(m.select("chain", "tx_hash", F.col("token_id").alias("event_id"), "from_address", "to_address", F.col("gas_native").alias("amount"), F.col("block_number").alias("at"), "contract_address"))


def _operators(moved: DataFrame) -> DataFrame:
    """Addresses that moved tokens of three contracts at least."""
    return graph.repeated_addresses(moved, 3).select("chain", "address")


def classified_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows by their side of a set of addresses, each once."""
    found = flows.merged(flows.classified(land(_flows(spark, d), "flows"), land(_operators(_moved(spark, d)), "operators")))
    return found.withColumn("amount", F.round("amount", 9))


def _moved(spark: SparkSession, d: str) -> DataFrame:
    return events.movements(table(spark, d, "transfers"))


def flows_near_mints(spark: SparkSession, d: str) -> DataFrame:
    """Flows at most 1,000 blocks from the span of their chain's mints, counted by chain."""
    spans = _moved(spark, d).filter("is_mint").groupBy("chain").agg(F.min("block_number").alias("first"), F.max("block_number").alias("last"))
    return flows.in_window(_flows(spark, d), spans, 1000).groupBy("chain").agg(F.count(F.lit(1)).alias("n"))


def mint_outflows(spark: SparkSession, d: str) -> DataFrame:
    """What buyers of mints sent in the transaction, where one address got it."""
    coin = flows.tidy_flows(_native(spark, d))
    return flows.mint_outflows(_moved(spark, d), coin).withColumns({c: F.round(c, 9) for c in ("paid", "paid_each")})


def paid_mints(spark: SparkSession, d: str) -> DataFrame:
    """Mints with the payment that is known of them, from their own columns and the coin's movements."""
    moved = land(_moved(spark, d), "moved")
    found = flows.with_mint_payments(moved, flows.tidy_flows(_native(spark, d))).filter("mint_payment_native is not null")
    return found.groupBy("chain", "contract_address").agg(F.count(F.lit(1)).alias("paid_mints"), F.round(F.sum("mint_payment_native"), 6).alias("paid_native"), F.min("mint_payment_receiver").alias("first_receiver"))


def flow_facts(spark: SparkSession, d: str) -> DataFrame:
    """Moves, tokens, addresses and the address that got most, by contract."""
    found = flows.facts(land(_moved(spark, d), "moved"), _flows(spark, d), events.CONTRACT)
    return found.withColumns({c: F.round(c, 6) for c in ("flows_in", "receiver_amount", "receiver_share")})


def controllers(spark: SparkSession, d: str) -> DataFrame:
    """Controllers of contracts by three fields: an address, the same in 32 bytes, and one that is missing at times."""
    m = _moved(spark, d).filter("from_address rlike '^0x[0-9a-f]{40}$'").groupBy(*events.CONTRACT).agg(F.min("from_address").alias("owner"), F.max("from_address").alias("o"), F.min("mint_payment_receiver").alias("creator"))
    words = m.withColumn("admin", F.concat(F.lit("0x" + "0" * 24), F.substring("o", 3, 40)))
    return flows.controllers_of(words, ["owner", "admin", "creator"])


def controller_continuity(spark: SparkSession, d: str) -> DataFrame:
    """Related contracts that one address controls."""
    from twinledger.operators import scopes

    named = land(_moved(spark, d).filter("is_mint and mint_payment_receiver is not null").select(*events.CONTRACT, F.col("mint_payment_receiver").alias("controller")), "controllers")
    pairs = scopes.unified_relations(table(spark, d, "seed_relations"))
    return flows.shared_controllers(named, named, pairs)


def _states(spark: SparkSession, d: str) -> DataFrame:
    """States of three kinds of evidence of each contract, from its transfers."""
    n = _moved(spark, d).groupBy(*events.CONTRACT).agg(F.count(F.lit(1)).alias("moves"), F.count("gas_native").alias("gas"), F.count("mint_payment_native").alias("paid"), F.count(F.when(F.col("mint_payment_native").isNotNull() & F.col("mint_payment_usd").isNull(), 1)).alias("unpriced"))
    s = {"transfers": evidence.page_state(F.col("moves"), F.col("moves") > 20), "gas_state": evidence.page_state(F.col("gas"), F.lit(False), F.col("gas") * 2 < F.col("moves")), "payments": evidence.page_state(F.col("paid"), F.lit(False))}
    return n.withColumns(s)


def evidence_states(spark: SparkSession, d: str) -> DataFrame:
    """The combined state of each contract's evidence, and whether nothing is missing."""
    s = _states(spark, d)
    kinds = [F.col(c) for c in ("transfers", "gas_state", "payments")]
    return s.select(*events.CONTRACT, evidence.combined_state(*kinds).alias("state"), evidence.is_complete(kinds, [F.col("unpriced")], F.col("moves") == 1).alias("complete"))


def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.state_counts(_states(spark, d), ["chain"], ["transfers", "gas_state", "payments"])


def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """Why evidence is cut off, by chain."""
    why = F.array(F.when(F.col("transfers") == "truncated", "pages"), F.when(F.col("gas_state") == "failed", "receipts"))
    return evidence.reason_counts(_states(spark, d).withColumn("why", why), ["chain"], "why")


def unambiguous_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that only one contract bears, with its first block as value."""
    a = table(spark, d, "nft_assets", "symbol", "contract_address", "first_seen_block").filter("symbol is not null")
    return evidence.unambiguous(a, ["symbol"], "contract_address", "first_seen_block")


def decoded_logs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of event logs of all three kinds, made from the transfers' blocks."""
    word = lambda n: F.lpad(F.hex(n), 64, "0")
    pad = F.lit("0x" + "0" * 64)
    raw = _raw(spark, d).filter("block_number is not null and contract_address is not null")
    n = F.col("block_number")
    logs = F.array(
        F.struct(F.array(F.lit("0x" + decode.TRANSFER), pad, pad, F.concat(F.lit("0x"), word(n))).alias("topics"), F.lit(None).cast("string").alias("data")),
        F.struct(F.array(F.lit("0x" + decode.TRANSFER_SINGLE), pad, pad, pad).alias("topics"), F.concat(F.lit("0x"), word(n + 1), word(F.lit(1))).alias("data")),
        F.struct(F.array(F.lit(decode.TRANSFER_BATCH.upper()), pad, pad, pad).alias("topics"), F.concat(F.lit("0x"), word(F.lit(64)), word(F.lit(160)), word(F.lit(2)), word(n + 2), word(n + 3), word(F.lit(0))).alias("data")),
        F.struct(F.array(pad).alias("topics"), F.lit("0x").alias("data")),
    )
    each = raw.select(F.col("contract_address").alias("address"), "block_number", F.explode(logs).alias("l")).select("address", "l.topics", "l.data", "block_number")
    return decode.log_tokens(each)


def decoded_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Names, symbols and URIs of metadata accounts in binary form, made from the assets."""
    a = table(spark, d, "nft_assets", "asset_id", "asset_name", "symbol", "token_uri").filter("asset_name is not null and symbol is not null and token_uri is not null")

    def written(c: str):
        n = F.lpad(F.hex(F.octet_length(c)), 8, "0")
        return F.concat(F.unhex(F.concat(F.substring(n, 7, 2), F.substring(n, 5, 2), F.substring(n, 3, 2), F.substring(n, 1, 2))), F.encode(F.col(c), "UTF-8"))

    key = F.unhex(F.sha2(F.col("asset_id").cast("string"), 256))
    data = F.concat(F.unhex(F.lit("04")), key, key, written("asset_name"), written("symbol"), written("token_uri"), F.unhex(F.lit("0000" + "00" + "00" + "01" + "00" + "00")))
    found = a.select("asset_id", decode.metadata_accounts(data).alias("m"))
    return found.filter("m is not null").select("asset_id", "m.name", "m.symbol", "m.uri", F.length("m.mint").between(32, 44).alias("has_mint"))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Filled-in URIs, documents inside URIs, ABI texts, hexadecimal ids and texts as a column stores them."""
    a = table(spark, d, "nft_assets", "asset_id", "asset_name", "token_uri", "metadata", "first_seen_block").filter("token_uri is not null and metadata is not null and asset_name is not null")
    uri = F.encode(F.col("token_uri"), "UTF-8")
    abi = F.concat(F.lit("0x"), F.lpad(F.lit("20"), 64, "0"), F.lpad(F.hex(F.octet_length("token_uri")), 64, "0"), F.hex(uri), F.lit("00" * 7))
    return a.select(
        "asset_id", text.fill_token_id(F.concat(F.lit("ipfs://c/{id}.json#"), F.col("asset_id").cast("string")), F.col("first_seen_block").cast("string")).alias("filled"),
        text.inline_json(F.concat(F.lit("data:application/json;base64,"), F.base64(F.encode(F.col("metadata"), "UTF-8")))).alias("inlined"), text.inline_json(F.concat(F.lit("data:application/json,"), F.url_encode("metadata"))).alias("written"), text.abi_string(abi).alias("abi"),
        text.hex_to_decimal(F.concat(F.lit("0x"), F.hex("first_seen_block"), F.lit("0" * 16))).alias("id"), _storable(F.concat(F.lit("\u0000"), F.col("asset_name")), 8).alias("stored"),
    )


def picture_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Suffixes of picture files, by media type for every fourth asset, by first bytes for every fourth, else by URI."""
    a = table(spark, d, "nft_assets", "asset_id", "image_uri")
    turn = F.col("asset_id") % 4
    media = F.when(turn == 0, "image/jpeg; charset=binary").when(turn == 1, "text/html")
    head = F.when(turn == 2, F.unhex(F.lit("4749463839610000"))).when(turn == 3, F.encode(F.lit("<?xml?><SVG>"), "UTF-8"))
    return a.select("asset_id", text.picture_suffix(media, F.col("image_uri"), head).alias("suffix"))


def _storable(value, most: int):
    from twinledger.operators.staging import storable

    return storable(value, most)


QUERIES = {
    f.__name__: f
    for f in (
        reply_transfers, listed_transfers, preferred_transfers, reply_holders, populations, reply_sales, market_sales, reply_receipts, gas_by_receipt, owner_changes, coin_moves, collection_assets, native_moves,
        classified_flows, flows_near_mints, mint_outflows, paid_mints, flow_facts, controllers, controller_continuity, evidence_states, state_counts, reason_counts, unambiguous_symbols, decoded_logs, decoded_accounts, text_forms, picture_suffixes,
    )
}

_ZERO = "'0x" + "0" * 40 + "'"
_TOKEN = "CASE WHEN regexp_full_match(trim(token_id), '[0-9]+') THEN regexp_replace(trim(token_id), '^0+(.)', '\\1') ELSE trim(token_id) END"
_TIME = "CAST(floor(epoch(block_ts)) AS BIGINT)"
_REPLY = f"""
rt AS (SELECT chain, contract_address, coalesce(tx_hash, '') tx_hash, {_TOKEN} token_id, lower(coalesce(from_address, '')) from_address, lower(coalesce(to_address, '')) to_address, {_TIME} "at", block_number,
  lower(coalesce(from_address, '')) IN ('', {_ZERO}) is_mint FROM transfers WHERE chain IS NOT NULL AND contract_address IS NOT NULL AND trim(token_id) <> '')"""
_HELD = f"""
ho AS (SELECT chain, contract_address, lower(to_address) "owner", CASE WHEN token_id IS NULL THEN '' ELSE {_TOKEN} END token_id, CASE WHEN block_number = 0 THEN '0' ELSE CAST(CAST(block_number AS HUGEINT) * 1208925819614629174706176 AS VARCHAR) END balance FROM transfers
  WHERE chain IS NOT NULL AND contract_address IS NOT NULL AND coalesce(lower(to_address), '') NOT IN ('', {_ZERO}))"""
_NATIVE = f"""
nm AS (SELECT lower(trim(chain)) chain, lower(trim(tx_hash)) tx_hash, coalesce(tx_hash, '') || CASE WHEN tx_hash IS NOT NULL AND token_id IS NOT NULL THEN ':' ELSE '' END || coalesce(token_id, '') event_id, nullif(lower(to_address), '') from_address, nullif(lower(mint_payment_receiver), '') to_address,
  mint_payment_native amount, block_number FROM transfers WHERE mint_payment_native IS NOT NULL AND chain IS NOT NULL AND contract_address IS NOT NULL AND trim(tx_hash) <> '' AND (coalesce(to_address, '') <> '' OR coalesce(mint_payment_receiver, '') <> '')),
nf AS (SELECT chain, {_address("chain", "tx_hash")} tx_hash, event_id, {_address("chain", "from_address")} from_address, {_address("chain", "to_address")} to_address, amount FROM nm),
ng AS (SELECT * FROM nf WHERE from_address IS NOT NULL AND to_address IS NOT NULL AND from_address <> to_address)"""
_FLOWS = "fl AS (SELECT chain, tx_hash, token_id event_id, from_address, to_address, gas_native amount, block_number pos, contract_address FROM m WHERE tx_hash IS NOT NULL AND from_address <> to_address)"
_OUT = """
mc AS (SELECT chain, tx_hash, to_address buyer, count(*) mints FROM m WHERE is_mint AND tx_hash IS NOT NULL AND to_address IS NOT NULL GROUP BY ALL),
sn AS (SELECT chain, tx_hash, from_address buyer, sum(amount) paid, min(to_address) receiver FROM ng WHERE amount > 0 GROUP BY ALL HAVING min(to_address) = max(to_address)),
mo AS (SELECT chain, tx_hash, buyer, mints, paid, receiver, paid / mints paid_each FROM mc JOIN sn USING (chain, tx_hash, buyer))"""
_STATE = """
sq AS (SELECT chain, contract_address, count(*) moves, count(gas_native) gas, count(mint_payment_native) paid, count(*) FILTER (WHERE mint_payment_native IS NOT NULL AND mint_payment_usd IS NULL) unpriced FROM m GROUP BY ALL),
sv AS (SELECT *, CASE WHEN moves > 20 THEN 'truncated' WHEN moves > 0 THEN 'complete' ELSE 'empty' END transfers, CASE WHEN gas * 2 < moves THEN 'failed' WHEN gas > 0 THEN 'complete' ELSE 'empty' END gas_state,
  CASE WHEN paid > 0 THEN 'complete' ELSE 'empty' END payments FROM sq)"""
_HEX = "lower(to_hex({}))"

ORACLES = {
    "reply_transfers": f"WITH {_REPLY} SELECT * FROM rt",
    "listed_transfers": f"WITH {_REPLY} SELECT * FROM rt",
    "preferred_transfers": f"WITH {_REPLY}, mi AS (SELECT DISTINCT chain, contract_address FROM rt WHERE is_mint) SELECT chain, contract_address, count(*) moves, count(*) FILTER (WHERE is_mint) mints FROM rt WHERE is_mint OR NOT EXISTS (SELECT 1 FROM mi WHERE mi.chain = rt.chain AND mi.contract_address = rt.contract_address) GROUP BY ALL",
    "reply_holders": f"WITH {_HELD} SELECT chain, \"owner\", count(*) n, count(balance) known, arg_max(balance, (length(balance), balance)) highest FROM ho GROUP BY ALL",
    "populations": f"""WITH {_HELD}, s AS (SELECT chain, contract_address, count(*) n FROM transfers WHERE chain IS NOT NULL AND contract_address IS NOT NULL GROUP BY ALL)
        SELECT s.chain, s.contract_address, CASE WHEN s.n <= 50 AND NOT coalesce(bool_or(token_id = ''), false) THEN count(DISTINCT token_id) FILTER (WHERE token_id <> '' AND balance IS DISTINCT FROM '0') END nfts FROM s LEFT JOIN ho USING (chain, contract_address) GROUP BY s.chain, s.contract_address, s.n""",
    "reply_sales": f"""SELECT chain, contract_address, coalesce(tx_hash, '') tx_hash, {_TOKEN} token_id, {_address("chain", "from_address")} seller, {_address("chain", "to_address")} buyer, {_TIME} "at", block_number,
        CASE WHEN coalesce(is_mint, false) OR block_number IS NULL THEN CASE WHEN block_number IS NOT NULL THEN CASE WHEN block_number = 0 THEN '0' ELSE CAST(block_number AS VARCHAR) || lpad(CAST(block_number AS VARCHAR), 40, '0') END END END price_raw,
        coalesce(is_mint, false) AND block_number IS NOT NULL priced, round(block_number / 1000, 3) royalty_part FROM transfers WHERE chain IS NOT NULL AND contract_address IS NOT NULL AND trim(from_address) <> '' AND trim(to_address) <> '' AND trim(token_id) <> ''""",
    "market_sales": f"""SELECT lower(trim(chain)) chain, contract_address, coalesce(tx_hash, '') tx_hash, {_TOKEN} token_id, {_address("chain", "from_address")} seller, {_address("chain", "to_address")} buyer, {_TIME} "at", round(block_number / 1e6, 6) amount, 'USDC' symbol
        FROM transfers WHERE chain IS NOT NULL AND contract_address IS NOT NULL AND trim(from_address) <> '' AND trim(to_address) <> '' AND trim(token_id) <> ''""",
    "reply_receipts": """SELECT tx_hash, round(max(block_number / 1e9), 9) gas_native, min(nullif(lower(trim(from_address)), '')) fee_payer, count(*) receipts FROM transfers WHERE tx_hash IS NOT NULL AND block_number IS NOT NULL AND chain IS NOT NULL AND contract_address IS NOT NULL GROUP BY ALL""",
    "gas_by_receipt": f"""WITH {_MOVES}, rc AS (SELECT lower(trim(tx_hash)) h, max(block_number / 1e9) g, min(nullif(lower(trim(from_address)), '')) p FROM transfers WHERE tx_hash IS NOT NULL AND block_number IS NOT NULL AND chain IS NOT NULL AND contract_address IS NOT NULL GROUP BY ALL)
        SELECT chain, tx_hash, round(max(coalesce(gas_native, g)), 9) gas_native, min(coalesce(fee_payer, p)) fee_payer, count(*) events FROM m LEFT JOIN rc ON h = lower(tx_hash) WHERE tx_hash IS NOT NULL GROUP BY ALL""",
    "owner_changes": """WITH o AS (SELECT tx_hash, token_id, coalesce(is_mint, false) is_mint, trim(coalesce(from_address, '')) f, trim(coalesce(to_address, '')) t FROM transfers WHERE chain IS NOT NULL AND contract_address IS NOT NULL AND tx_hash IS NOT NULL AND token_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY tx_hash, token_id) = 1)
        SELECT tx_hash AS signature, token_id mint, CASE WHEN NOT is_mint THEN f END from_owner, t to_owner, is_mint FROM o WHERE t <> '' AND (is_mint OR f <> '')""",
    "coin_moves": """SELECT tx_hash AS signature, CASE WHEN block_number % 2 = 1 THEN 'instruction:1' ELSE 'balance:0:1' END event_id, CASE WHEN block_number % 2 = 1 THEN trim(from_address) ELSE from_address END from_address, CASE WHEN block_number % 2 = 1 THEN trim(to_address) ELSE to_address END to_address,
        CASE WHEN block_number % 2 = 1 AND trim(from_address) <> '' AND trim(to_address) <> '' THEN round(block_number / 1e6, 9) ELSE round(block_number / 1e9, 9) END amount FROM transfers
        WHERE chain IS NOT NULL AND contract_address IS NOT NULL AND tx_hash IS NOT NULL AND block_number > 0 AND from_address <> '' AND to_address <> '' AND trim(from_address) <> '' AND trim(to_address) <> ''""",
    "collection_assets": """SELECT contract_address collection, CAST(asset_id AS VARCHAR) mint, image_uri "owner", asset_name AS name, symbol, token_uri uri, array_to_string(list_sort(list_distinct(list_filter([trim(chain), trim(symbol)], lambda x: x <> ''))), ',') authorities
        FROM nft_assets WHERE contract_address IS NOT NULL AND asset_id % 5 <> 0""",
    "native_moves": f"WITH {_NATIVE} SELECT chain, tx_hash, nullif(trim(event_id), '') event_id, from_address, to_address, round(amount, 9) amount, block_number FROM nm",
    "classified_flows": f"""WITH {_MOVES}, {_FLOWS}, op AS (SELECT chain, address FROM (SELECT DISTINCT chain, contract_address, unnest([from_address, to_address]) address FROM m) WHERE address IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
        cl AS (SELECT fl.*, EXISTS (SELECT 1 FROM op WHERE op.chain = fl.chain AND address = from_address) s, EXISTS (SELECT 1 FROM op WHERE op.chain = fl.chain AND address = to_address) g FROM fl)
        SELECT chain, tx_hash, event_id, from_address, to_address, round(max(amount), 9) amount, CASE WHEN s AND g THEN 'revenue_backflow' WHEN g THEN 'funding' ELSE 'withdrawal' END kind FROM cl WHERE s OR g GROUP BY ALL""",
    "flows_near_mints": f"WITH {_MOVES}, {_FLOWS}, sp AS (SELECT chain, min(block_number) lo, max(block_number) hi FROM m WHERE is_mint GROUP BY chain) SELECT chain, count(*) n FROM fl JOIN sp USING (chain) WHERE pos BETWEEN lo - 1000 AND hi + 1000 GROUP BY chain",
    "mint_outflows": f"WITH {_MOVES}, {_NATIVE}, {_OUT} SELECT chain, tx_hash, buyer, mints, round(paid, 9) paid, receiver, round(paid_each, 9) paid_each FROM mo",
    "paid_mints": f"""WITH {_MOVES}, {_NATIVE}, {_OUT}, pm AS (SELECT m.*, CASE WHEN mint_payment_native > 0 AND mint_payment_receiver IS NOT NULL THEN mint_payment_native END own, mo.paid, mo.receiver, (SELECT mints FROM mc WHERE mc.chain = m.chain AND mc.tx_hash = m.tx_hash AND mc.buyer = m.to_address) k
          FROM m LEFT JOIN mo ON mo.chain = m.chain AND mo.tx_hash = m.tx_hash AND mo.buyer = m.to_address WHERE is_mint),
        pb AS (SELECT chain, contract_address, CASE WHEN own IS NULL OR (paid IS NOT NULL AND (paid, receiver) > (own, mint_payment_receiver)) THEN paid ELSE own END / coalesce(k, 1) p, CASE WHEN own IS NULL OR (paid IS NOT NULL AND (paid, receiver) > (own, mint_payment_receiver)) THEN receiver ELSE mint_payment_receiver END r FROM pm WHERE own IS NOT NULL OR paid IS NOT NULL)
        SELECT chain, contract_address, count(*) paid_mints, round(sum(p), 6) paid_native, min(r) first_receiver FROM pb GROUP BY ALL""",
    "flow_facts": f"""WITH {_MOVES}, {_FLOWS}, mv AS (SELECT chain, contract_address, count(*) FILTER (WHERE coalesce(is_mint, false)) mints, count(*) FILTER (WHERE NOT coalesce(is_mint, false)) transfers, count(DISTINCT token_id) FILTER (WHERE token_id <> '') nfts FROM m GROUP BY ALL),
        ad AS (SELECT chain, contract_address, count(DISTINCT a) addresses FROM (SELECT chain, contract_address, unnest([from_address, to_address]) a FROM m) WHERE a <> {_ZERO} GROUP BY ALL),
        gt AS (SELECT chain, contract_address, to_address, sum(amount) amount FROM fl WHERE amount > 0 GROUP BY ALL),
        bs AS (SELECT chain, contract_address, sum(amount) flows_in, arg_min(to_address, (-amount, to_address)) receiver, max(amount) receiver_amount FROM gt GROUP BY ALL)
        SELECT mv.*, coalesce(addresses, 0) addresses, round(flows_in, 6) flows_in, receiver, round(receiver_amount, 6) receiver_amount, round(receiver_amount / flows_in, 6) receiver_share FROM mv LEFT JOIN ad USING (chain, contract_address) LEFT JOIN bs USING (chain, contract_address)""",
    "controllers": f"""WITH {_MOVES}, ow AS (SELECT chain, contract_address, min(from_address) "owner", max(from_address) "admin", min(mint_payment_receiver) creator FROM m WHERE regexp_full_match(from_address, '0x[0-9a-f]{{40}}') GROUP BY ALL),
        cu AS (SELECT chain, contract_address, 'owner' f, "owner" a FROM ow UNION ALL SELECT chain, contract_address, 'admin', "admin" FROM ow UNION ALL SELECT chain, contract_address, 'creator', creator FROM ow)
        SELECT chain, contract_address, a controller, array_to_string(list_sort(list_distinct(list(f))), ',') fields FROM cu WHERE a <> {_ZERO} AND (chain = 'solana' OR regexp_full_match(a, '0x[0-9a-f]{{40}}')) GROUP BY ALL""",
    "evidence_states": f"""WITH {_MOVES}, {_STATE} SELECT chain, contract_address, CASE WHEN gas_state = 'failed' THEN 'failed' WHEN transfers = 'truncated' THEN 'truncated' WHEN transfers = 'empty' AND gas_state = 'empty' AND payments = 'empty' THEN 'empty' ELSE 'complete' END state,
        moves = 1 OR (transfers <> 'truncated' AND gas_state <> 'failed' AND unpriced = 0) complete FROM sv""",
    "state_counts": f"""WITH {_MOVES}, {_STATE}, sx AS (SELECT chain, 'transfers' kind, transfers s FROM sv UNION ALL SELECT chain, 'gas_state', gas_state FROM sv UNION ALL SELECT chain, 'payments', payments FROM sv)
        SELECT chain, kind, {", ".join(f"count(*) FILTER (WHERE s = '{x}') {x}" for x in evidence.STATES)} FROM sx GROUP BY ALL""",
    "reason_counts": f"WITH {_MOVES}, {_STATE} SELECT chain, reason, count(*) n FROM (SELECT chain, 'pages' reason FROM sv WHERE transfers = 'truncated' UNION ALL SELECT chain, 'receipts' FROM sv WHERE gas_state = 'failed') GROUP BY ALL",
    "unambiguous_symbols": "SELECT symbol, min(first_seen_block) first_seen_block FROM nft_assets WHERE symbol IS NOT NULL GROUP BY symbol HAVING min(coalesce(contract_address, '')) = max(coalesce(contract_address, '')) AND min(first_seen_block) IS NOT NULL",
    "decoded_logs": """WITH b AS (SELECT lower(trim(contract_address)) contract_address, block_number n FROM transfers WHERE block_number IS NOT NULL AND contract_address IS NOT NULL AND chain IS NOT NULL),
        l AS (SELECT contract_address, n t, 'ERC-721' s, n FROM b UNION ALL SELECT contract_address, n + unnest([1, 2, 3]), 'ERC-1155', n FROM b) SELECT contract_address, CAST(t AS VARCHAR) token_id, s token_standard, min(n) block_number FROM l GROUP BY ALL""",
    "decoded_accounts": r"SELECT asset_id, regexp_replace(asset_name, '^\s+|\s+$', '', 'g') AS name, regexp_replace(symbol, '^\s+|\s+$', '', 'g') symbol, regexp_replace(token_uri, '^\s+|\s+$', '', 'g') uri, true has_mint FROM nft_assets WHERE asset_name IS NOT NULL AND symbol IS NOT NULL AND token_uri IS NOT NULL",
    "picture_suffixes": f"""WITH x AS (SELECT asset_id, lower(regexp_extract(image_uri, '^[^?#]*')) p FROM nft_assets),
        y AS (SELECT asset_id, CASE {" ".join(f"WHEN p LIKE '%{s}' THEN '{text.SAME_SUFFIX.get(s, s)}'" for s in [*text.PICTURE_TYPES.values(), *text.SAME_SUFFIX])} END s FROM x)
        SELECT asset_id, CASE WHEN asset_id % 4 = 0 THEN '.jpg' ELSE coalesce(s, CASE asset_id % 4 WHEN 2 THEN '.gif' WHEN 3 THEN '.svg' END) END suffix FROM y""",
    "text_forms": f"""SELECT asset_id, 'ipfs://c/' || coalesce(lpad({_HEX.format("first_seen_block")}, 64, '0'), '{{id}}') || '.json#' || asset_id filled, metadata inlined, metadata written, token_uri abi, CASE WHEN first_seen_block = 0 THEN '0' ELSE CAST(CAST(first_seen_block AS HUGEINT) * 18446744073709551616 AS VARCHAR) END id,
        substring(asset_name, 1, 8) stored FROM nft_assets WHERE token_uri IS NOT NULL AND metadata IS NOT NULL AND asset_name IS NOT NULL""",
}
ORACLES["controller_continuity"] = f"""WITH {_MOVES}, co AS (SELECT DISTINCT chain, contract_address, mint_payment_receiver c FROM m WHERE is_mint AND mint_payment_receiver IS NOT NULL),
  r AS (SELECT DISTINCT lower(trim(seed_chain)) seed_chain, {_address("seed_chain", "seed_address")} seed_address, lower(trim(candidate_chain)) candidate_chain, {_address("candidate_chain", "candidate_address")} candidate_address FROM seed_relations)
  SELECT seed_chain, seed_address, candidate_chain, candidate_address, array_to_string(list_sort(list(a.c)), ',') controllers FROM r JOIN co a ON a.chain = seed_chain AND a.contract_address = seed_address JOIN co b ON b.chain = candidate_chain AND b.contract_address = candidate_address AND b.c = a.c
  WHERE seed_chain <> candidate_chain OR seed_address <> candidate_address GROUP BY ALL"""
