import json

import pytest
from pyspark.sql import functions as F

from twinledger.functions import decode
from twinledger.functions.text import base58_encode
from twinledger.sources import providers


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def pages(spark, *payloads):
    return spark.createDataFrame([("base", "0xc", p if p is None or isinstance(p, str) else json.dumps(p)) for p in payloads], "chain string, contract_address string, payload string")


def test_transfers(spark):
    page = {"result": {"transfers": [
        {"hash": "h1", "from": "0x" + "0" * 40, "to": "0xAB", "erc721TokenId": "0x0a", "blockNum": "0x10", "metadata": {"blockTimestamp": "2024-01-01T00:00:10Z"}},
        {"transactionHash": "h2", "from": "0xA", "to": None, "erc1155Metadata": [{"tokenId": "0x1"}, {"tokenId": "007"}], "blockNum": 5, "metadata": {"blockTimestamp": 77}},
        {"hash": "h3", "from": "0xA"},
    ]}}
    found = rows(providers.transfers(pages(spark, page, "bad", None, {})), "tx_hash", "token_id", "to_address", "at", "block_number", "is_mint")
    assert found == [("h1", "10", "0xab", 1704067210, 16, True), ("h2", "1", "", 77, 5, False), ("h2", "7", "", 77, 5, False)]


def test_holders(spark):
    page = {"owners": [{"ownerAddress": "0xA", "tokenBalances": [{"tokenId": "1", "balance": "0x2"}, {"tokenId": "2", "balance": "x"}]}, {"ownerAddress": "0xB", "tokenBalances": []}, {"ownerAddress": "0x" + "0" * 40}, {"ownerAddress": None}]}
    assert rows(providers.holders(pages(spark, page)), "owner", "token_id", "balance") == [("0xa", "1", "2"), ("0xa", "2", None), ("0xb", "", None)]
    large = {"owners": [{"ownerAddress": "0xA", "tokenBalances": [{"tokenId": "1", "balance": "0x" + "f" * 64}, {"tokenId": "2", "balance": str(10**70)}]}]}
    assert rows(providers.holders(pages(spark, large)), "balance") == [(str(2**256 - 1),), (str(10**70),)][::-1]


def test_sales_in_one_currency_only(spark):
    fee = lambda n, s, d=2: {"amount": n, "symbol": s, "decimals": d}
    item = lambda **k: {"transactionHash": "t", "sellerAddress": "0xS", "buyerAddress": "0xB", "tokenId": "1"} | k
    page = {"nftSales": [item(sellerFee=fee("100", "eth"), royaltyFee=fee(50, "ETH")), item(tokenId="2", sellerFee=fee("100", "eth"), protocolFee=fee("1", "usd")), item(tokenId="3", sellerFee=fee("1", "eth"), royaltyFee=fee("1", "eth", 3)), item(tokenId="4"), item(sellerAddress=" "), item(tokenId="5", sellerFee=fee("x", "eth"))]}
    assert rows(providers.sales(pages(spark, page)), "token_id", "amount", "price_raw", "royalty_part") == [("1", 1.5, "150", 0.5), ("2", None, None, None), ("3", None, None, 0.001), ("4", None, None, None), ("5", None, None, None)]


def test_receipts(spark):
    df = spark.createDataFrame([("a", '{"gasUsed":"0x5208","effectiveGasPrice":"0x3b9aca00","from":" 0xAB "}'), ("b", '{"gasUsed":"0x1"}'), ("c", None)], "tx_hash string, payload string")
    assert rows(providers.receipts(df)) == [("a", 2.1e-5, "0xab")]


def test_owner_changes(spark):
    def tx(pre, post):
        side = lambda x: [{"accountIndex": a, "mint": "M", "owner": o, "uiTokenAmount": {"amount": n}} for a, o, n in x]
        return json.dumps({"meta": {"preTokenBalances": side(pre), "postTokenBalances": side(post)}})

    data = [("move", tx([(1, "A", "1")], [(1, "A", "0"), (2, "B", "1")])), ("mint", tx([], [(1, "C", "1")])), ("same", tx([(1, "A", "1")], [(1, "D", "1")])), ("burn", tx([(1, "A", "1")], [])), ("none", None)]
    df = spark.createDataFrame([(s, "M", p) for s, p in data], "signature string, mint string, payload string")
    assert rows(providers.owner_changes(df), "signature", "from_owner", "to_owner", "is_mint") == [("mint", None, "C", True), ("move", "A", "B", False), ("same", "A", "D", False)]


def test_rankings(spark):
    df = spark.createDataFrame([("base", json.dumps({"data": [{"contract": "0xA", "ranking": "2", "name": "n"}, {"address": "0xB"}, {"name": "no address"}]})), ("base", "bad")], "chain string, payload string")
    assert rows(providers.ranked_collections(df), "address", "seed_rank", "collection_name") == [("0xa", 2, "n"), ("0xb", 2, None)]


def test_open_licences_by_marks_in_values(spark):
    texts = ['{"license":"CC0-1.0"}', '{"a":[{"b":"In the Public Domain."}]}', '{"public domain":"no"}', '{"license":"CC0"}', '{"l":"Creative Commons BY-NC"}', '["CC Zero"]', '"license: cc0"', '{"l":"MIT license"}', "public domain", '{"l":"public domain"', None, "", '{"x":"say \\"public domain\\":"}']
    found = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").orderBy("i").select(providers.licensed_open(F.col("j"))).collect()]
    assert found == [True, True, False, False, False, True, True, False, False, False, False, False, True]


def test_prices_are_exact_at_any_length(spark):
    fee = {"symbol": "eth", "decimals": 18}
    page = {"nftSales": [{"transactionHash": "t", "sellerAddress": "0xS", "buyerAddress": "0xB", "tokenId": "1", "sellerFee": fee | {"amount": str(10**60)}, "royaltyFee": fee | {"amount": "0001"}}]}
    assert rows(providers.sales(pages(spark, page)), "price_raw") == [(str(10**60 + 1),)]


def test_assets_of_a_database(spark, tmp_path):
    """A database that comes with Spark stands for any."""
    from twinledger.sources import snapshot

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    data = [(i, i, f"0x{i}", "ipfs://u", "", f"n{i}", "old", "new", i * 10) for i in range(5)]
    df = spark.createDataFrame(data, "id long, token_id long, contract_address string, token_uri string, image_uri string, name string, metadata string, raw_metadata string, first_seen_block long")
    texts = ("contract_address", "token_uri", "image_uri", "name", "metadata", "raw_metadata")
    df.write.format("jdbc").option("quoteIdentifiers", "false").options(url=url, dbtable="assets", createTableColumnTypes=", ".join(f"{c} VARCHAR(200)" for c in texts)).save()
    columns = spark.read.format("jdbc").options(url=url, dbtable="assets").load().columns
    plain = ", ".join(f'"{c}" AS {c}' for c in columns)
    found = snapshot.read_assets(spark, url, f"(SELECT {plain} FROM assets) AS a", "base", blocks=(10, 30), text_type="CHAR(20)", isolation="VALUES 1")
    assert sorted((r.source_order, r.token_id.strip(), r.asset_name, r.symbol, r.metadata.strip()) for r in found.collect()) == [(i, str(i), f"n{i}", None, "new") for i in (1, 2, 3)]
    assert snapshot.exported(found).count() == 3
    with pytest.raises(ValueError):
        snapshot.metadata_column(["id"])
    options = snapshot.jdbc_options(url, "assets", df.columns, blocks=(10, 30), partitions=2, bounds=(0, 5), text_type="VARCHAR(250)", user="u")
    assert "BETWEEN 10 AND 30" in options["dbtable"] and "CAST(raw_metadata AS VARCHAR(250)) AS metadata" in options["dbtable"] and options["numPartitions"] == "2" and options["user"] == "u"
