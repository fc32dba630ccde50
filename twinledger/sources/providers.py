"""Rows from provider replies that were stored as JSON text; fetching them is not this library's work."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.functions.text import hex_to_decimal, plain_decimal
from twinledger.identity import tidy_address
from twinledger.operators.events import ZERO
from twinledger.operators.shred import loads

_FEE = "struct<amount:string,quantity:string,decimals:int,symbol:string,contractAddress:string,contract_address:string,tokenAddress:string,recipient:string,recipientAddress:string>"
# The members that replies hold.
TRANSFERS = "result struct<transfers:array<struct<hash:string,transactionHash:string,from:string,to:string,blockNum:string,tokenId:string,erc721TokenId:string,erc1155Metadata:array<struct<tokenId:string>>,metadata:struct<blockTimestamp:string>>>>"
HOLDERS = "owners array<struct<ownerAddress:string,tokenBalances:array<struct<tokenId:string,balance:string>>>>"
SALES = f"nftSales array<struct<transactionHash:string,sellerAddress:string,buyerAddress:string,tokenId:string,blockTimestamp:string,timestamp:string,blockNumber:string,blockNum:string,marketplace:string,sellerFee:{_FEE},protocolFee:{_FEE},royaltyFee:{_FEE}>>"
RECEIPT = "struct<gasUsed:string,effectiveGasPrice:string,gasPrice:string,from:string>"
BALANCES = "array<struct<accountIndex:long,mint:string,owner:string,uiTokenAmount:struct<amount:string>>>"
META = f"meta struct<preTokenBalances:{BALANCES},postTokenBalances:{BALANCES}>"
NATIVE = "result struct<pageKey:string,transfers:array<struct<category:string,hash:string,transactionHash:string,uniqueId:string,from:string,to:string,value:double,rawContract:struct<value:string,decimal:string,decimals:int>,blockNum:string,metadata:struct<blockTimestamp:string>>>>"
LISTED = "result array<map<string,string>>"
MARKET_SALES = "asset_events array<struct<event_type:string,type:string,transaction:string,transaction_hash:string,seller:string,buyer:string,event_timestamp:string,total_price:string,nft:struct<identifier:string,token_id:string,contract:string>,payment:struct<quantity:string,amount:string,decimals:int,symbol:string,contract_address:string,token_address:string,address:string>>>"
_GROUP = "struct<group_key:string,group_value:string,collection_metadata:struct<update_authority:string,updateAuthority:string>>"
ASSETS = f"result struct<items:array<struct<id:string,burnt:boolean,interface:string,content:struct<json_uri:string,metadata:struct<name:string,symbol:string>>,grouping:array<{_GROUP}>,creators:array<struct<address:string,verified:boolean>>,ownership:struct<owner:string>>>>"
_STEP = "struct<parsed:struct<type:string,info:struct<source:string,from:string,destination:string,to:string,lamports:long>>>"
SOL = f"transaction struct<message:struct<accountKeys:array<struct<pubkey:string>>,instructions:array<{_STEP}>>>, meta struct<fee:long,preBalances:array<long>,postBalances:array<long>,innerInstructions:array<struct<instructions:array<{_STEP}>>>>"
LAMPORTS = 1_000_000_000
#: members that name a ranked collection's address, rank and name, in order of preference
RANKED = {"address": ["contract_address", "contract", "address"], "rank": ["rank", "ranking"], "name": ["name", "contract_name", "collection"]}


def number(text: Column) -> Column:
    """A whole number in decimal or 0x-hexadecimal text; null if it is none or exceeds 63 bits."""
    value = F.trim(text)
    return F.when(value.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(value, F.lit(3), F.length(value)), 16, 10).cast("long")).otherwise(value.try_cast("long"))


def whole(text: Column) -> Column:
    """A whole number of any length, in decimal or 0x-hexadecimal text, as decimal text without leading zeros; null if it is none.

    Amounts and balances have up to 256 bits, more than any numeric type holds; `text.token_order` compares such texts by magnitude.
    """
    value = F.trim(text)
    return F.when(value.rlike("^0[xX][0-9a-fA-F]+$"), hex_to_decimal(value)).when(value.rlike("^[0-9]+$"), plain_decimal(value))


def whole_sum(parts: Column) -> Column:
    """The sum of an array of decimal texts of any length, as decimal text; null elements add nothing, an empty or null array gives null."""

    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None or not len(x) else str(sum(int(v) for v in x if v is not None)))

    return of(parts)


def seconds(text: Column) -> Column:
    """A time in seconds since 1970, or as RFC 3339; null if it is neither."""
    value = F.trim(text)
    return F.coalesce(value.try_cast("long"), F.unix_seconds(F.try_to_timestamp(value)))


def token_id(text: Column) -> Column:
    """A token id in decimal without leading zeros; hexadecimal ones are converted, others trimmed, null is empty."""
    value = F.trim(F.coalesce(text, F.lit("")))
    return F.when(value.rlike("^0[xX]"), F.coalesce(F.when(F.length(value) <= 66, hex_to_decimal(value)), value)).otherwise(plain_decimal(value))


def _items(pages: DataFrame, schema: str, path: str) -> DataFrame:
    return pages.withColumn("__j", F.from_json("payload", schema)).withColumn("i", F.explode(f"__j.{path}")).drop("__j")


def transfers(pages: DataFrame) -> DataFrame:
    """(chain, contract_address, tx_hash, token_id, from_address, to_address, at, block_number, is_mint) of pages (chain, contract_address, payload).

    An item moves its one token, or each token of its list. Items without tokens, and payloads that are not JSON, give no rows.
    """
    one = F.coalesce("i.erc721TokenId", "i.tokenId")
    ids = F.when(F.size("i.erc1155Metadata") > 0, F.col("i.erc1155Metadata.tokenId")).otherwise(F.array(one))
    each = _items(pages, TRANSFERS, "result.transfers").withColumn("raw", F.explode(ids)).withColumn("token_id", token_id(F.col("raw")))
    sender = F.lower(F.coalesce("i.from", F.lit("")))
    return each.filter("token_id <> ''").select(
        "chain", "contract_address", F.coalesce("i.hash", "i.transactionHash", F.lit("")).alias("tx_hash"), "token_id", sender.alias("from_address"), F.lower(F.coalesce("i.to", F.lit(""))).alias("to_address"),
        seconds(F.col("i.metadata.blockTimestamp")).alias("at"), number(F.col("i.blockNum")).alias("block_number"), ((sender == "") | (sender == ZERO)).alias("is_mint"),
    )


def holders(pages: DataFrame) -> DataFrame:
    """(chain, contract_address, owner, token_id, balance): an owner without balances has one row with an empty token id; zero owners none.

    balance is decimal text, see whole, as balances may have 256 bits; null if it is no number.
    """
    owners = _items(pages, HOLDERS, "owners").withColumn("owner", F.lower(F.coalesce("i.ownerAddress", F.lit("")))).filter((F.col("owner") != "") & (F.col("owner") != ZERO))
    each = owners.withColumn("b", F.explode_outer("i.tokenBalances"))
    return each.select("chain", "contract_address", "owner", token_id(F.col("b.tokenId")).alias("token_id"), whole(F.col("b.balance")).alias("balance"))


def _fee(name: str, chain: Column) -> Column:
    f = F.col(f"i.{name}")
    raw = F.coalesce(f["amount"], f["quantity"])
    fee = F.struct(
        plain_decimal(raw).alias("raw"), F.coalesce(f["decimals"], F.lit(18)).alias("decimals"), (raw.cast("double") / F.pow(F.lit(10.0), F.coalesce(f["decimals"], F.lit(18)))).alias("amount"),
        F.lower(f["symbol"]).alias("symbol"), tidy_address(chain, F.coalesce(f["contractAddress"], f["contract_address"], f["tokenAddress"])).alias("address"),
    )
    return F.when(raw.rlike("^[0-9]+$"), fee)


def sales(pages: DataFrame) -> DataFrame:
    """(chain, contract_address, tx_hash, token_id, seller, buyer, at, block_number, marketplace, amount, price_raw, seller_part, market_part, royalty_part).

    The amount is the sum of its parts, and null unless all parts are in one currency: the same decimals and address, or without
    addresses no two different symbols. price_raw, in the smallest unit, is exact at any length. Sales without seller, buyer or token are left out.
    """
    chain = F.col("chain")
    with_fees = _items(pages, SALES, "nftSales").withColumns({n: _fee(f, chain) for n, f in (("s", "sellerFee"), ("p", "protocolFee"), ("r", "royaltyFee"))})
    parts = with_fees.withColumn("parts", F.filter(F.array("s", "p", "r"), lambda x: x.isNotNull()))
    first = F.col("parts")[0]
    same = F.forall("parts", lambda x: (x["decimals"] == first["decimals"]) & F.when(x["address"].isNull() & first["address"].isNull(), F.coalesce(x["symbol"] == first["symbol"], F.lit(True))).otherwise(F.coalesce(x["address"] == first["address"], F.lit(False))))
    one = (F.size("parts") > 0) & same
    total = lambda m, zero: F.when(one, F.aggregate(F.col(f"parts.{m}"), zero, lambda a, b: a + b))
    out = parts.select(
        "chain", "contract_address", F.coalesce("i.transactionHash", F.lit("")).alias("tx_hash"), token_id(F.col("i.tokenId")).alias("token_id"), tidy_address(chain, F.col("i.sellerAddress")).alias("seller"), tidy_address(chain, F.col("i.buyerAddress")).alias("buyer"),
        seconds(F.coalesce("i.blockTimestamp", "i.timestamp")).alias("at"), number(F.coalesce("i.blockNumber", "i.blockNum")).alias("block_number"), F.col("i.marketplace").alias("marketplace"),
        total("amount", F.lit(0.0)).alias("amount"), whole_sum(F.when(one, F.col("parts.raw"))).alias("price_raw"),
        F.col("s.amount").alias("seller_part"), F.col("p.amount").alias("market_part"), F.col("r.amount").alias("royalty_part"),
    )
    return out.filter("seller is not null and buyer is not null and token_id <> ''")


def receipts(pages: DataFrame) -> DataFrame:
    """(tx_hash, gas_native, fee_payer) of (tx_hash, payload): gas used times its price, in units of 10^18; replies without both are left out."""
    r = pages.withColumn("r", F.from_json("payload", RECEIPT))
    used, price = whole(F.col("r.gasUsed")).cast("double"), whole(F.coalesce("r.effectiveGasPrice", "r.gasPrice")).cast("double")
    out = r.select("tx_hash", (used * price).alias("wei"), F.nullif(F.lower(F.trim("r.from")), F.lit("")).alias("fee_payer"))
    return out.filter("wei is not null").select("tx_hash", (F.col("wei") / 1e18).alias("gas_native"), "fee_payer")


def native_moves(pages: DataFrame) -> DataFrame:
    """(chain, tx_hash, event_id, from_address, to_address, amount, at, block_number) of pages (chain, payload) of plain transfers of a chain's coin.

    The amount is the reply's own, else the raw one over its decimals (18 if not said). Items of another category, without a hash or without any
    end are left out.
    """
    each = pages.withColumn("i", F.explode(F.from_json("payload", NATIVE)["result"]["transfers"]))
    raw = whole(F.col("i.rawContract.value")).cast("double") / F.pow(F.lit(10.0), F.coalesce(whole(F.col("i.rawContract.decimal")).cast("int"), F.col("i.rawContract.decimals"), F.lit(18)))
    end = lambda c: F.nullif(F.lower(F.coalesce(F.col(f"i.{c}"), F.lit(""))), F.lit(""))
    out = each.select(
        "chain", F.nullif(F.lower(F.trim(F.coalesce("i.hash", "i.transactionHash"))), F.lit("")).alias("tx_hash"), F.nullif(F.trim("i.uniqueId"), F.lit("")).alias("event_id"), end("from").alias("from_address"), end("to").alias("to_address"),
        F.coalesce("i.value", raw).alias("amount"), seconds(F.col("i.metadata.blockTimestamp")).alias("at"), number(F.col("i.blockNum")).alias("block_number"), F.lower(F.coalesce("i.category", F.lit(""))).alias("c"),
    )
    return out.filter("c in ('', 'external') and tx_hash is not null and (from_address is not null or to_address is not null)").drop("c")


def listed_transfers(pages: DataFrame) -> DataFrame:
    """The columns of transfers, of pages of an explorer that lists one token move per item with numbers as decimal text."""
    i = pages.withColumn("i", F.explode(F.from_json("payload", LISTED)["result"]))
    of = lambda c: F.col("i")[c]
    sender = F.lower(F.coalesce(of("from"), F.lit("")))
    out = i.select(
        "chain", "contract_address", F.coalesce(of("hash"), F.lit("")).alias("tx_hash"), token_id(F.coalesce(of("tokenID"), of("tokenId"))).alias("token_id"), sender.alias("from_address"), F.lower(F.coalesce(of("to"), F.lit(""))).alias("to_address"),
        seconds(of("timeStamp")).alias("at"), number(of("blockNumber")).alias("block_number"), ((sender == "") | (sender == ZERO)).alias("is_mint"),
    )
    return out.filter("token_id <> ''")


def _party(text: Column) -> Column:
    """An address given as text or in an object."""
    return F.coalesce(F.get_json_object(text, "$.address"), F.get_json_object(text, "$.hash"), F.when(~text.startswith("{"), text))


def market_sales(pages: DataFrame) -> DataFrame:
    """(chain, contract_address, tx_hash, token_id, seller, buyer, at, amount, symbol, currency) of pages of a marketplace's events.

    Events of another type count only if they name a payment; those of another contract don't. Amounts are over the payment's decimals, else 18,
    on solana 9; such replies do not split fees. Sales without seller, buyer or token are left out.
    """
    chain = F.col("chain")
    i = pages.withColumn("i", F.explode(F.from_json("payload", MARKET_SALES)["asset_events"]))
    kind = F.lower(F.coalesce("i.event_type", "i.type", F.lit("sale")))
    paid = F.col("i.payment").isNotNull() | F.col("i.total_price").isNotNull()
    raw = F.coalesce("i.payment.quantity", "i.payment.amount", "i.total_price").try_cast("double")
    decimals = F.coalesce("i.payment.decimals", F.when(chain == "solana", 9).otherwise(18))
    own = F.coalesce(tidy_address(chain, _party(F.col("i.nft.contract"))) == tidy_address(chain, F.col("contract_address")), F.lit(True))
    out = i.filter((kind.isin("sale", "order") | paid) & own).select(
        "chain", "contract_address", F.coalesce(_party(F.col("i.transaction")), F.col("i.transaction_hash"), F.lit("")).alias("tx_hash"), token_id(F.coalesce("i.nft.identifier", "i.nft.token_id")).alias("token_id"),
        tidy_address(chain, _party(F.col("i.seller"))).alias("seller"), tidy_address(chain, _party(F.col("i.buyer"))).alias("buyer"), seconds(F.col("i.event_timestamp")).alias("at"),
        (raw / F.pow(F.lit(10.0), decimals)).alias("amount"), F.col("i.payment.symbol").alias("symbol"), tidy_address(chain, F.coalesce("i.payment.contract_address", "i.payment.token_address", "i.payment.address")).alias("currency"),
    )
    return out.filter("seller is not null and buyer is not null and token_id <> ''")


def collection_assets(pages: DataFrame) -> DataFrame:
    """(collection, mint, owner, name, symbol, uri, interface, authorities) of pages (collection, payload) of a collection's assets; burnt ones and those without id are left out.

    authorities: sorted, the update authorities of the collection's group and the verified creators of the asset, comma-separated.
    """
    i = pages.withColumn("i", F.explode(F.from_json("payload", ASSETS)["result"]["items"])).filter("i.id <> '' and not coalesce(i.burnt, false)")
    own = F.filter("i.grouping", lambda g: (g["group_key"] == "collection") & F.coalesce(g["group_value"] == F.col("collection"), F.lit(True)))[0]["collection_metadata"]
    verified = F.transform(F.filter("i.creators", lambda c: F.coalesce(c["verified"], F.lit(False))), lambda c: c["address"])
    named = F.transform(F.concat(F.array(own["update_authority"], own["updateAuthority"]), F.coalesce(verified, F.array().cast("array<string>"))), lambda a: F.trim(a))
    listed = F.array_join(F.sort_array(F.array_distinct(F.filter(named, lambda a: a != ""))), ",")
    return i.select("collection", F.col("i.id").alias("mint"), F.col("i.ownership.owner").alias("owner"), F.col("i.content.metadata.name").alias("name"), F.col("i.content.metadata.symbol").alias("symbol"), F.col("i.content.json_uri").alias("uri"), F.col("i.interface").alias("interface"), listed.alias("authorities"))


def sol_moves(pages: DataFrame) -> DataFrame:
    """(signature, event_id, from_address, to_address, amount) of (signature, payload): movements of the coin in a transaction, in whole coins.

    The parsed transfer instructions, outer before inner, with their index among all instructions. Where there is none, the balances: if apart
    from the first account's fee one account lost and one got, what is the smaller of both moved between them.
    """
    p = pages.select("signature", F.from_json("payload", SOL).alias("j")).select("signature", F.col("j.transaction.message").alias("m"), "j.meta")
    inner = F.flatten(F.transform(F.coalesce("meta.innerInstructions", F.array().cast(f"array<struct<instructions:array<{_STEP}>>>")), lambda g: g["instructions"]))
    steps = F.concat(F.coalesce("m.instructions", F.array().cast(f"array<{_STEP}>")), inner)

    def step(x: Column, i: Column) -> Column:
        info = x["parsed"]["info"]
        return F.struct(F.concat(F.lit("instruction:"), i.cast("string")).alias("event_id"), F.trim(F.coalesce(info["source"], info["from"])).alias("from_address"), F.trim(F.coalesce(info["destination"], info["to"])).alias("to_address"), F.when(x["parsed"]["type"].isin("transfer", "transferWithSeed"), info["lamports"]).alias("lamports"))

    told = F.filter(F.transform(steps, step), lambda s: (s["lamports"] > 0) & (s["from_address"] != "") & (s["to_address"] != ""))
    keys, pre, post = F.transform("m.accountKeys", lambda a: a["pubkey"]), F.col("meta.preBalances"), F.col("meta.postBalances")
    delta = F.transform(keys, lambda a, i: F.struct(i.alias("i"), a.alias("a"), (F.get(post, i) - F.get(pre, i) + F.when(i == 0, F.coalesce("meta.fee", F.lit(0))).otherwise(0)).alias("d")))
    q = p.withColumns({"told": told, "delta": F.when((F.size(keys) == F.size(pre)) & (F.size(pre) == F.size(post)), F.filter(delta, lambda x: x["a"] != ""))})
    q = q.withColumns({"gave": F.filter("delta", lambda x: x["d"] < 0), "got": F.filter("delta", lambda x: x["d"] > 0)})
    one = F.when((F.size("gave") == 1) & (F.size("got") == 1), F.array(F.struct(F.concat_ws(":", F.lit("balance"), F.col("gave")[0]["i"], F.col("got")[0]["i"]).alias("event_id"), F.col("gave")[0]["a"].alias("from_address"), F.col("got")[0]["a"].alias("to_address"), F.least(-F.col("gave")[0]["d"], F.col("got")[0]["d"]).alias("lamports"))))
    found = q.select("signature", F.explode(F.when(F.size("told") > 0, F.col("told")).otherwise(one)).alias("x"))
    return found.select("signature", "x.event_id", "x.from_address", "x.to_address", (F.col("x.lamports") / LAMPORTS).alias("amount"))


def owner_changes(pages: DataFrame) -> DataFrame:
    """(signature, mint, from_owner, to_owner, is_mint) of (signature, mint, payload): who lost and who got most of a token in a transaction.

    Balances of the token are compared by account. The owner with the greatest gain got it; it is a mint if nobody held any before, and
    then has no giver; otherwise the owner with the greatest loss gave it. An account that changes owner without a change of amount
    moves its amount. Transactions without a receiver, or neither mint nor giver, give no row. Ties go to the smaller owner.
    """
    parsed = pages.withColumn("j", F.from_json("payload", META)).select("signature", "mint", "j.meta.*")

    def side(c: str, when: str) -> DataFrame:
        own = parsed.select("signature", "mint", F.explode(c).alias("b")).filter("b.mint = mint and b.accountIndex is not null")
        return own.select("signature", "mint", F.col("b.accountIndex").alias("a"), F.trim(F.coalesce("b.owner", F.lit(""))).alias(f"{when}_owner"), F.col("b.uiTokenAmount.amount").try_cast("decimal(38,0)").alias(when)).filter(F.col(when).isNotNull())

    both = side("preTokenBalances", "pre").join(side("postTokenBalances", "post"), ["signature", "mint", "a"], "full_outer").withColumns({"pre": F.coalesce("pre", F.lit(0)), "post": F.coalesce("post", F.lit(0)), "pre_owner": F.coalesce("pre_owner", F.lit("")), "post_owner": F.coalesce("post_owner", F.lit(""))})
    delta = F.col("post") - F.col("pre")
    handed = (delta == 0) & (F.col("pre") > 0) & (F.col("pre_owner") != F.col("post_owner"))
    gave = F.when(((delta < 0) | handed) & (F.col("pre_owner") != ""), F.struct(F.when(handed, -F.col("pre")).otherwise(delta).alias("d"), F.col("pre_owner").alias("o")))
    got = F.when(((delta > 0) | handed) & (F.col("post_owner") != ""), F.struct((-F.when(handed, F.col("post")).otherwise(delta)).alias("d"), F.col("post_owner").alias("o")))
    out = both.groupBy("signature", "mint").agg(F.sum("pre").alias("before"), F.min(gave).alias("g"), F.min(got).alias("t"))
    out = out.select("signature", "mint", F.when(F.col("before") > 0, F.col("g.o")).alias("from_owner"), F.col("t.o").alias("to_owner"), (F.col("before") == 0).alias("is_mint"))
    return out.filter("to_owner is not null and (is_mint or from_owner is not null)")


def ranked_collections(pages: DataFrame, path: str = "data") -> DataFrame:
    """(chain, address, seed_rank, collection_name, page_position) of (chain, payload): a list of objects under ``path``, by any of the names of RANKED."""
    each = pages.select("chain", F.posexplode(F.from_json(F.get_json_object("payload", f"$.{path}"), "array<map<string,string>>")).alias("p", "i"))
    pick = lambda what: F.coalesce(*(F.col("i")[k] for k in RANKED[what]))
    out = each.select("chain", tidy_address(F.col("chain"), pick("address")).alias("address"), F.coalesce(number(pick("rank")), F.col("p") + 1).cast("int").alias("seed_rank"), pick("name").alias("collection_name"), F.col("p").alias("page_position"))
    return out.filter("address is not null")


# Texts that mark a work as free of rights.
OPEN_MARKS = ["cc0-1.0", "license: cc0", "creative commons zero", "public domain", "cc zero"]


def _marked(text: str | None) -> bool:
    try:
        stack = [loads(text)]
    except (ValueError, TypeError):
        return False
    while stack:
        value = stack.pop()
        if isinstance(value, (dict, list)):
            stack.extend(value.values() if isinstance(value, dict) else value)
        elif isinstance(value, str) and any(m in value.lower() for m in OPEN_MARKS):
            return True
    return False


def licensed_open(document: Column) -> Column:
    """Whether any text value in a JSON document, at any depth, holds one of OPEN_MARKS, in any case; keys don't count. False for null and for what is no JSON."""

    @F.pandas_udf("boolean")
    def of(values: pd.Series) -> pd.Series:
        return values.map(_marked).astype(bool)

    return of(document)
