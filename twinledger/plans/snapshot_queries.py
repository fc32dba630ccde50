"""Queries over snapshot, assets, seeds, relations and transfers, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions import documents as json_forms
from twinledger.functions import text
from twinledger.identity import tidy_address, tidy_chain
from twinledger.operators import events, evidence, graph, metadata_match, name_match, ranking, sampling, scopes, staging, uri_match
from twinledger.plans import pipeline
from twinledger.runtime import land, shared_path, table
from twinledger.sources import providers, sinks
from twinledger.sources import snapshot as source
from twinledger.streaming import ingest

NAME_THRESHOLD, METADATA_THRESHOLD = 0.95, 0.6
#: how many seeds ranked_seeds lists of each ranking
SEEDS_PER_RANKING = 25


def _rows(spark: SparkSession, d: str, *dimensions: str) -> DataFrame:
    return source.read_snapshot(spark, f"{d}/snapshot.parquet", source.ReadOptions(dimensions=dimensions, order="row_id"))


def _tokens(spark: SparkSession, d: str, *dimensions: str) -> DataFrame:
    return source.tokens(_rows(spark, d, *dimensions))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Every contract that is a seed."""
    return source.seed_contracts(table(spark, d, "seeds"))


def snapshot_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, "name", "token_uri", "image_uri").withColumnRenamed("source_order", "first_row")


def snapshot_totals(spark: SparkSession, d: str) -> DataFrame:
    return source.chain_totals(_rows(spark, d))


def snapshot_one_chain(spark: SparkSession, d: str) -> DataFrame:
    options = source.ReadOptions(chains=["base"], dimensions=["token_uri"], order="row_id")
    return source.read_snapshot(spark, f"{d}/snapshot.parquet", options).groupBy("contract_address").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token_uri_norm").alias("uris"))


def snapshot_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return source.uri_conflicts(_rows(spark, d, "token_uri", "image_uri"))


def snapshot_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The row of the first valid metadata of each token."""
    return source.anchors(_rows(spark, d, "metadata")).select(*source.KEY, F.col("source_order").alias("row_id"))


def highest_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The highest token id of each contract, by magnitude where ids are decimal."""
    rows = _rows(spark, d).select(*source.KEY, text.token_order(F.col("token_id")).alias("o"))
    return rows.groupBy("chain", "contract_address").agg(F.max(F.struct("o", "token_id")).alias("m")).select("chain", "contract_address", text.plain_decimal(F.col("m.token_id")).alias("token_id"))


def url_forms(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nft_assets", "asset_id", "token_uri", "image_uri")
    return a.select("asset_id", text.normalize_url(F.col("token_uri")).alias("token_uri_norm"), text.normalize_url(F.col("image_uri")).alias("image_uri_norm"), text.url_suffix(F.col("image_uri")).alias("suffix"), text.gateway_url(text.normalize_url(F.col("image_uri"))).alias("image_url"))


def asset_facts(spark: SparkSession, d: str) -> DataFrame:
    """Per asset: whether its address has its chain's form, whether its name is usable, and the picture its metadata names."""
    a = table(spark, d, "nft_assets", "asset_id", "chain", "contract_address", "asset_name", "metadata")
    return a.select("asset_id", text.valid_address(F.col("chain"), F.col("contract_address")).alias("valid_address"), text.usable_name(F.col("asset_name")).alias("usable_name"), text.image_of(F.col("metadata")).alias("image"))


def exported_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Assets as a snapshot, written by chain and read again."""
    path = shared_path(spark, "export")
    sinks.write_snapshot(source.exported(table(spark, d, "nft_assets")), path)
    return spark.read.parquet(path).withColumn("chain", F.col("chain").cast("string"))


def export_counts(spark: SparkSession, d: str) -> DataFrame:
    found = source.exported(table(spark, d, "nft_assets"), names=False)
    given = lambda c: F.count(F.when(F.col(c) != "", 1)).alias(c)
    return found.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), given("contract_address"), given("token_uri_norm"), given("image_uri_norm"), given("metadata_json"))


def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    """Assets by canonical metadata: copies of one document under any spelling."""
    a = table(spark, d, "nft_assets", "asset_id", "metadata").select("asset_id", json_forms.canonical_json(F.col("metadata")).alias("document"))
    return a.filter("document is not null").groupBy("document").agg(F.min("asset_id").alias("asset_id"), F.count(F.lit(1)).alias("copies")).select("asset_id", "copies")


def token_uri_scopes(spark: SparkSession, d: str) -> DataFrame:
    return uri_match.token_uri_counts(_tokens(spark, d, "token_uri"))


def token_uri_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, "token_uri")
    found = scopes.with_ratios(uri_match.token_uri_counts(source.tokens(rows)), source.chain_totals(rows))
    return found.select("kind", "primary_chain", "secondary_chain", F.round("contract_ratio", 9).alias("contract_ratio"), F.round("nft_ratio", 9).alias("nft_ratio"))


def image_uri_scopes(spark: SparkSession, d: str) -> DataFrame:
    return uri_match.image_uri_counts(_tokens(spark, d, "token_uri", "image_uri"))


def name_bearers(spark: SparkSession, d: str) -> DataFrame:
    return name_match.name_members(_tokens(spark, d, "name"))


def exact_name_scopes(spark: SparkSession, d: str) -> DataFrame:
    return name_match.name_counts(name_match.name_members(_tokens(spark, d, "name")))


def fuzzy_name_pairs(spark: SparkSession, d: str) -> DataFrame:
    members = name_match.name_members(_tokens(spark, d, "name"))
    return name_match.name_pairs(land(members.select("name").distinct(), "names"), NAME_THRESHOLD).select("a", "b", F.round("similarity", 9).alias("similarity"))


def fuzzy_name_scopes(spark: SparkSession, d: str) -> DataFrame:
    members = land(name_match.name_members(_tokens(spark, d, "name")), "members")
    pairs = land(name_match.name_pairs(land(members.select("name").distinct(), "names"), NAME_THRESHOLD), "pairs")
    return name_match.name_counts(members, pairs)


def metadata_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Contracts whose aligned metadata documents match."""
    found = metadata_match.similar_contracts(source.anchors(_rows(spark, d, "metadata")), METADATA_THRESHOLD)
    return found.withColumn("score", F.round("score", 9))


def _text_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The first metadata of each token as it is, in lower case, so that SQL can make the same documents."""
    return source.first_texts(land(_rows(spark, d, "metadata"), "rows"))


def text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Contracts whose aligned metadata texts match by BM25 cosine."""
    return metadata_match.similar_contracts(_text_anchors(spark, d), METADATA_THRESHOLD).withColumn("score", F.round("score", 6))


def text_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scope counts of contracts and single solana tokens whose metadata texts match."""
    return metadata_match.metadata_counts(_text_anchors(spark, d), _tokens(spark, d), METADATA_THRESHOLD)


def text_profiles(spark: SparkSession, d: str) -> DataFrame:
    """How many contracts or tokens each list of documents stands for, known by the smallest of them."""
    members, tops = metadata_match.profiled(land(metadata_match.units_of(_text_anchors(spark, d), True), "units"))
    sizes = members.groupBy("profile").agg(F.count(F.lit(1)).alias("members"))
    return tops.join(sizes, "profile").select("chain", "contract_address", "unit", "aligned", "members")


def text_scopes_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Scope counts at a threshold of 0, where everything with metadata matches."""
    return metadata_match.metadata_counts(_text_anchors(spark, d), _tokens(spark, d), 0.0)


def lowest_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The three lowest tokens with metadata of each contract, and the two highest."""
    found = _text_anchors(spark, d)
    each = source.bounded(found, 3).withColumn("end", F.lit("low")).unionByName(source.bounded(found, 2, highest=True).withColumn("end", F.lit("high")))
    return each.select(*source.KEY, "end", F.col("source_order").alias("row_id"))


def ranked_seeds(spark: SparkSession, d: str) -> DataFrame:
    return staging.top_seeds(table(spark, d, "seeds"), SEEDS_PER_RANKING)


def seed_uri_scale(spark: SparkSession, d: str) -> DataFrame:
    return uri_match.seed_uri_scale(_tokens(spark, d, "token_uri", "image_uri"), _seeds(spark, d))


def seed_uri_scale_images_apart(spark: SparkSession, d: str) -> DataFrame:
    return uri_match.seed_uri_scale(_tokens(spark, d, "token_uri", "image_uri"), _seeds(spark, d), images_apart=True)


def seed_uri_scale_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return uri_match.seed_uri_scale(_tokens(spark, d, "token_uri", "image_uri"), _seeds(spark, d), by_scope=True)


def relations_unified(spark: SparkSession, d: str) -> DataFrame:
    return scopes.unified_relations(table(spark, d, "seed_relations"))


def relations_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return scopes.relation_counts(scopes.unified_relations(table(spark, d, "seed_relations")))


def relation_shares(spark: SparkSession, d: str) -> DataFrame:
    """Relations by scope, with the contracts that there are where the candidates lie."""
    counts = scopes.relation_counts(scopes.unified_relations(table(spark, d, "seed_relations")))
    return scopes.scale_with_denominators(counts, source.chain_totals(_rows(spark, d)).select("chain", "contracts")).withColumn("candidate_share", F.round("candidate_share", 9))


def sampled_in_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Four relations of each scope of a sample, by hash priority."""
    found = sampling.pair_scopes(scopes.unified_relations(table(spark, d, "seed_relations")), "seed_chain", "candidate_chain")
    key = ["seed_chain", "seed_address", "candidate_chain", "candidate_address"]
    return sampling.sample_per_scope(found, ["scope", "chain", "other"], key, 4, "7").select("scope", "chain", "other", *key, "rank")


def sampled_group_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of contracts with one name a sample of 20 holds of each name."""
    members = name_match.name_members(_tokens(spark, d, "name")).select("name", F.concat_ws(":", "chain", "contract_address").alias("contract"))
    found = sampling.sample_group_pairs(members, "name", "contract", 20)
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("a", "b").alias("different"))


def names_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Names of each chain in the order of their length and text."""
    names = name_match.name_members(_tokens(spark, d, "name")).select("chain", "name").distinct()
    return ranking.with_rank(names, ["chain"], [F.length("name"), F.col("name")]).select("chain", "name", F.col("rank").cast("long").alias("rank"))


def related_name_hits(spark: SparkSession, d: str) -> DataFrame:
    """Contracts that bear a seed's name or one like it, of those only that relations name as candidates."""
    r = scopes.unified_relations(table(spark, d, "seed_relations"))
    return pipeline.restricted(seed_name_hits(spark, d), r.select(F.col("candidate_chain").alias("chain"), F.col("candidate_address").alias("contract_address")))


def unexcluded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per chain without contracts that an asset explicitly flags."""
    a = table(spark, d, "nft_assets", "chain", "contract_address", "token_standard")
    flags = a.select(tidy_chain(F.col("chain")).alias("chain"), tidy_address(F.col("chain"), F.col("contract_address")).alias("contract_address"), (F.lower("token_standard") == "erc1155").alias("excluded"))
    return evidence.without_listed(_tokens(spark, d), flags, ["chain", "contract_address"]).groupBy("chain").agg(F.count(F.lit(1)).alias("nfts"))


def overlaid_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per contract, those of seeds as the collectors list them."""
    found = source.exported(table(spark, d, "nft_assets"), names=False).filter("chain <> '' and contract_address <> '' and token_id <> ''")
    listed = found.select("chain", "contract_address", "token_id").distinct().join(_seeds(spark, d), ["chain", "contract_address"], "left_semi")
    return pipeline.overlay_seeds(_tokens(spark, d).select(*source.KEY), land(listed, "listed")).groupBy("chain", "contract_address").agg(F.count(F.lit(1)).alias("nfts"))


def sampled_relations(spark: SparkSession, d: str) -> DataFrame:
    """Five relations of each pair of chains, by hash priority."""
    key = ["seed_chain", "candidate_chain"], ["seed_address", "candidate_address"]
    return sampling.sample_per_scope(scopes.unified_relations(table(spark, d, "seed_relations")), *key, 5, "7").select(*key[0], *key[1], "rank")


def retry_images(spark: SparkSession, d: str) -> DataFrame:
    return staging.retry_queue(table(spark, d, "nft_assets"), 100)


def staged_assets(spark: SparkSession, d: str) -> DataFrame:
    """Per token of the assets with a contract, the row that was collected first."""
    a = table(spark, d, "nft_assets", "asset_id", "chain", "contract_address", "token_id", "created_at")
    a = a.withColumns({"chain": tidy_chain(F.col("chain")), "contract_address": tidy_address(F.col("chain"), F.col("contract_address"))}).filter("chain is not null and contract_address is not null and token_id is not null")
    return staging.insert_absent(a.limit(0), a, ["chain", "contract_address", "token_id"], [F.col("created_at").asc_nulls_last(), "asset_id"]).select("chain", "contract_address", "token_id", "asset_id")


def filled_assets(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the snapshot, their empty URIs filled from what the collectors found."""
    key = ["chain", "contract_address", "token_id"]
    old = _tokens(spark, d, "token_uri", "image_uri").select(*key, F.nullif("token_uri_norm", F.lit("")).alias("token_uri"), F.nullif("image_uri_norm", F.lit("")).alias("image_uri"))
    found = source.exported(table(spark, d, "nft_assets"), names=False).filter("contract_address <> '' and token_id <> ''")
    new = found.groupBy(*key).agg(F.min(F.nullif("token_uri_norm", F.lit(""))).alias("token_uri"), F.min(F.nullif("image_uri_norm", F.lit(""))).alias("image_uri"))
    return staging.upsert(new, old, key)


def inserted_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets of even ids added to those of odd ones where their token is new, names cut to ten signs."""
    a = table(spark, d, "nft_assets", "asset_id", "chain", "contract_address", "token_id", "asset_name").filter("chain is not null and contract_address is not null and token_id is not null")
    key = ["chain", "contract_address", "token_id"]
    odd = staging.insert_absent(a.limit(0), a.filter("asset_id % 2 = 1"), key, ["asset_id"])
    return staging.insert_assets(odd, a.filter("asset_id % 2 = 0").withColumn("asset_name", F.concat(F.lit("\u0000"), F.col("asset_name"))), key, ["asset_id"], {"asset_name": 10})


def usable_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets worth keeping; those of even ids tell their picture inside their URI, every 97th has it there itself."""
    a = table(spark, d, "nft_assets", "asset_id", "chain", "contract_address", "token_id", "token_uri", "image_uri").filter("chain is not null and contract_address is not null")
    inside = F.concat(F.lit("data:application/json;base64,"), F.base64(F.encode(F.concat(F.lit('{"image":"ipfs://p/'), F.col("asset_id").cast("string"), F.lit('"}')), "UTF-8")))
    even = F.col("asset_id") % 2 == 0
    told = a.withColumn("image_uri", F.when(F.col("asset_id") % 97 == 0, "data:image/png;base64,AA").when(even, None).otherwise(F.col("image_uri"))).withColumn("token_uri", F.when(even, inside).otherwise(F.col("token_uri")))
    return staging.usable_assets(told, ["ar://"]).select("asset_id", "image_uri", F.length("token_uri").alias("uri_length"))


def block_range(spark: SparkSession, d: str) -> DataFrame:
    """Records of the middle half of the blocks of all, by chain."""
    rows = table(spark, d, "snapshot", "chain", "first_seen_block")
    lo, hi = rows.agg(F.min("first_seen_block"), F.max("first_seen_block")).first()
    if lo is None:
        lo = hi = 0
    return source.in_blocks(rows, lo + (hi - lo) // 4, hi - (hi - lo) // 4).groupBy(tidy_chain(F.col("chain")).alias("chain")).agg(F.count(F.lit(1)).alias("n"))


def unlisted_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per chain, without the contracts of seeds."""
    left = staging.remove_listed(_tokens(spark, d), _seeds(spark, d), ["chain", "contract_address"])
    return left.groupBy("chain").agg(F.count(F.lit(1)).alias("nfts"))


def _moved(spark: SparkSession, d: str) -> DataFrame:
    return land(events.movements(table(spark, d, "transfers")), "moved")


def transfer_lifecycles(spark: SparkSession, d: str) -> DataFrame:
    return events.lifecycles(events.movements(table(spark, d, "transfers")))


def token_holders(spark: SparkSession, d: str) -> DataFrame:
    return events.holders(events.movements(table(spark, d, "transfers"))).select("chain", "contract_address", "token_id", "owner")


def first_disposals(spark: SparkSession, d: str) -> DataFrame:
    return events.first_disposals(events.movements(table(spark, d, "transfers")))


def paid_and_held(spark: SparkSession, d: str) -> DataFrame:
    return events.paid_and_held(_moved(spark, d))


def transaction_gas(spark: SparkSession, d: str) -> DataFrame:
    return events.transaction_gas(events.movements(table(spark, d, "transfers")))


def mint_payments(spark: SparkSession, d: str) -> DataFrame:
    return events.mint_payments(events.movements(table(spark, d, "transfers"))).withColumn("paid_native", F.round("paid_native", 6))


def gas_concentration(spark: SparkSession, d: str) -> DataFrame:
    """The share of a chain's gas that the highest tenth of its payers spent."""
    gas = events.transaction_gas(events.movements(table(spark, d, "transfers"))).filter("fee_payer is not null and gas_native is not null")
    paid = gas.groupBy("chain", "fee_payer").agg(F.round(F.sum("gas_native"), 9).alias("gas"))
    return ranking.top_share(paid, ["chain"], "gas", "fee_payer").withColumn("share", F.round("share", 6))


def receipt_gini(spark: SparkSession, d: str) -> DataFrame:
    """How unevenly a contract's moves spread over their receivers."""
    moved = events.movements(table(spark, d, "transfers")).filter("to_address is not null")
    got = moved.groupBy("chain", "contract_address", "to_address").agg(F.count(F.lit(1)).alias("n"))
    return ranking.gini(got, ["chain", "contract_address"], "n").withColumn("gini", F.round("gini", 9))


def nearest_moves(spark: SparkSession, d: str) -> DataFrame:
    """For each receiver in a contract, the last block before and the first after its span there, within 50,000, in which it got a token of any contract."""
    moved = _moved(spark, d).filter("to_address is not null and block_number is not null")
    owner = F.concat_ws(":", "chain", "to_address").alias("owner")
    spans = moved.groupBy("chain", "contract_address", owner).agg(F.min("block_number").alias("first"), F.max("block_number").alias("last"))
    return events.nearest_outside(spans, moved.select(owner, F.col("block_number").alias("at")), "owner", 50_000)


def address_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.address_edges(events.movements(table(spark, d, "transfers")))


def trading_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(graph.address_edges(_moved(spark, d)))


def cycle_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_sizes(graph.strong_components(graph.address_edges(_moved(spark, d))))


def fan_addresses(spark: SparkSession, d: str) -> DataFrame:
    return graph.fans(graph.address_edges(events.movements(table(spark, d, "transfers"))))


def inventory_shares(spark: SparkSession, d: str) -> DataFrame:
    moved = _moved(spark, d)
    return graph.inventories(moved, graph.address_edges(moved)).withColumns({c: F.round(c, 9) for c in ("token_share", "value_share")})


def layered_paths(spark: SparkSession, d: str) -> DataFrame:
    """First ways of tokens over three addresses, from addresses that moved tokens of two contracts."""
    moved = _moved(spark, d)
    return graph.layered_paths(moved, graph.repeated_addresses(moved))


def cycle_instances(spark: SparkSession, d: str) -> DataFrame:
    moved = _moved(spark, d)
    return graph.instances(moved, land(graph.strong_components(graph.address_edges(moved)), "cycles"), "gas_native").withColumn("value", F.round("value", 9))


def licensed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Assets by whether their metadata holds a mark of an open licence; the mark is put into the description of every third."""
    a = table(spark, d, "nft_assets", "asset_id", "metadata").filter("metadata is not null")
    text_ = F.when(F.col("asset_id") % 3 == 0, F.concat(F.lit('{"license":"CC0-1.0 ","m":'), F.col("metadata"), F.lit("}"))).when(F.col("asset_id") % 3 == 1, F.concat(F.lit('{"public domain":"no","m":'), F.col("metadata"), F.lit("}"))).otherwise(F.col("metadata"))
    return a.select("asset_id", providers.licensed_open(text_).alias("open"))


def token_handovers(spark: SparkSession, d: str) -> DataFrame:
    return graph.handovers(events.movements(table(spark, d, "transfers")))


def streamed_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.stream_table(spark, d, "snapshot").filter("ingested_at is not null")
    found = ingest.run_complete(ingest.daily_counts(rows), "daily")
    return found.select("chain", F.date_format("day", "yyyy-MM-dd").alias("day"), "records", "highest_block")


def streamed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by a stream into a table that takes each once, then counted by chain."""
    rows = ingest.token_keys(ingest.stream_table(spark, d, "snapshot", files_per_batch=8).select("row_id", "chain", "contract_address", "token_id")).filter("chain is not null and contract_address is not null and token_id is not null")
    base = shared_path(spark, "grown")
    ingest.grow(rows, base, ["chain", "contract_address", "token_id"], ["row_id"])
    return spark.read.schema(rows.schema).parquet(f"{base}/table").groupBy("chain").agg(F.count(F.lit(1)).alias("nfts"))


def metadata_scopes(spark: SparkSession, d: str) -> DataFrame:
    rows = land(_rows(spark, d, "metadata"), "rows")
    return pipeline.match_metadata(rows, source.tokens(rows), METADATA_THRESHOLD)


def sampled_metadata_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How many matched pairs of contracts with pictures a sample of three of one chain and three of two chains holds."""
    rows = land(_rows(spark, d, "image_uri", "metadata"), "rows")
    pairs = metadata_match.similar_contracts(source.anchors(rows), METADATA_THRESHOLD)
    return sampling.sample_pairs_with_pictures(pairs, source.tokens(rows), 3).groupBy("pool").agg(F.count(F.lit(1)).alias("pairs"))


def seed_name_hits(spark: SparkSession, d: str) -> DataFrame:
    """Contracts that bear the name of a seed or one like it."""
    members, seeds = land(name_match.name_members(_tokens(spark, d, "name")), "members"), land(_seeds(spark, d), "seeds")
    return name_match.seed_name_edges(members, seeds, pipeline.seed_name_pairs(members, seeds, NAME_THRESHOLD)).withColumn("score", F.round("score", 9))


def seed_hits(spark: SparkSession, d: str) -> DataFrame:
    """Contracts and tokens that each seed's hits reach, in every dimension and in all together; metadata as texts."""
    tokens = land(_tokens(spark, d, "name", "token_uri", "image_uri"), "tokens")
    return pipeline.scale_seeds(tokens, _rows(spark, d, "metadata"), _seeds(spark, d), NAME_THRESHOLD, METADATA_THRESHOLD)


def seed_documents(spark: SparkSession, d: str) -> DataFrame:
    """The metadata that a comparison with the seeds needs, parsed no more than that needs."""
    rows = land(_rows(spark, d, "metadata"), "rows")
    return source.seed_anchors(rows, _seeds(spark, d)).select(*source.KEY, F.col("source_order").alias("row_id"))


def seed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of the seeds' contracts."""
    return source.identities(_rows(spark, d), _seeds(spark, d)).withColumnRenamed("source_order", "row_id")


def seed_text_hits(spark: SparkSession, d: str) -> DataFrame:
    """Contracts whose metadata texts match a seed's."""
    seeds = land(_seeds(spark, d), "seeds")
    pairs = metadata_match.both_ways(metadata_match.similar_contracts(_text_anchors(spark, d), METADATA_THRESHOLD, seeds)).withColumn("score", F.round("score", 6))
    return pairs.join(seeds, ["chain", "contract_address"], "left_semi")


def snapshot_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole run on URIs and names, as its report."""
    report = pipeline.run_all(spark, f"{d}/snapshot.parquet", dimensions=("name", "uri"), name_threshold=None, order="row_id")
    return report.select(*scopes.COUNTS, F.round("contract_ratio", 9).alias("contract_ratio"), F.round("nft_ratio", 9).alias("nft_ratio"))


def repeated_addresses(spark: SparkSession, d: str) -> DataFrame:
    return graph.repeated_addresses(events.movements(table(spark, d, "transfers")))


def cycle_exits(spark: SparkSession, d: str) -> DataFrame:
    moved = _moved(spark, d)
    return graph.cycle_exits(moved, land(graph.strong_components(graph.address_edges(moved)), "cycles"))


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_tokens, snapshot_totals, snapshot_one_chain, snapshot_conflicts, snapshot_anchors, highest_tokens, url_forms, asset_facts, exported_snapshot, export_counts, canonical_documents,
        token_uri_scopes, token_uri_ratios, image_uri_scopes, name_bearers, exact_name_scopes, fuzzy_name_pairs, fuzzy_name_scopes, metadata_pairs, metadata_scopes, sampled_metadata_pairs, text_pairs, text_scopes, text_profiles, text_scopes_of_all, lowest_anchors, snapshot_report, seed_text_hits, seed_documents, seed_tokens,
        seed_uri_scale_by_scope, relation_shares, sampled_in_scopes, sampled_group_pairs, names_by_length, related_name_hits, unexcluded_tokens, overlaid_tokens, inserted_assets, usable_assets, block_range, layered_paths, cycle_instances, licensed_documents,
        ranked_seeds, seed_uri_scale, seed_uri_scale_images_apart, seed_name_hits, seed_hits, relations_unified, relations_by_scope, sampled_relations, retry_images, staged_assets, filled_assets, unlisted_tokens,
        transfer_lifecycles, token_holders, first_disposals, paid_and_held, transaction_gas, mint_payments, gas_concentration, receipt_gini, nearest_moves,
        address_edges, trading_cycles, cycle_sizes, cycle_exits, repeated_addresses, fan_addresses, inventory_shares, token_handovers, streamed_daily_counts, streamed_tokens,
    )
}


def _address(chain: str, address: str) -> str:
    return f"CASE WHEN trim({address}) = '' THEN NULL WHEN lower(trim({chain})) = 'solana' THEN trim({address}) ELSE lower(trim({address})) END"


_CLEAN = f"""
c AS (SELECT row_id, lower(trim(chain)) chain, {_address("chain", "contract_address")} contract_address, trim(token_id) token_id,
  coalesce(name_norm, '') name_norm, coalesce(token_uri_norm, '') token_uri_norm, coalesce(image_uri_norm, '') image_uri_norm FROM snapshot
  WHERE trim(chain) <> '' AND trim(contract_address) <> '' AND trim(token_id) <> ''),
k AS (SELECT chain, contract_address, token_id, min(row_id) first_row, coalesce(arg_min(name_norm, row_id) FILTER (WHERE trim(name_norm) <> ''), '') name_norm,
  coalesce(arg_min(token_uri_norm, row_id) FILTER (WHERE token_uri_norm <> ''), '') token_uri_norm,
  coalesce(arg_min(image_uri_norm, row_id) FILTER (WHERE image_uri_norm <> ''), '') image_uri_norm FROM c GROUP BY ALL)"""
_TOTALS = "t AS (SELECT chain, count(DISTINCT contract_address) contracts, count(DISTINCT (contract_address, token_id)) nfts FROM c GROUP BY chain)"
_SHARED = """
p AS (SELECT token_uri_norm u, chain, contract_address, count(*) n FROM k WHERE token_uri_norm <> '' GROUP BY ALL),
pc AS (SELECT u, chain, count(*) c FROM p GROUP BY ALL),
h AS (SELECT 'intra' kind, p.chain primary_chain, NULL secondary_chain, contract_address, n FROM p JOIN pc USING (u, chain) WHERE c > 1
  UNION ALL SELECT 'cross', chain, NULL, contract_address, n FROM p WHERE EXISTS (SELECT 1 FROM pc WHERE pc.u = p.u AND pc.chain <> p.chain)
  UNION ALL SELECT 'matrix', p.chain, pc.chain, contract_address, n FROM p JOIN pc ON pc.u = p.u AND pc.chain <> p.chain)"""
_COUNTED = "SELECT kind, primary_chain, secondary_chain, '{}' dimension, count(DISTINCT contract_address) duplicate_contract_count, CAST(sum(n) AS BIGINT) duplicate_nft_count FROM h GROUP BY ALL"
_IMAGES = """
p AS (SELECT token_uri_norm u, chain, contract_address FROM k WHERE token_uri_norm <> '' GROUP BY ALL),
pc AS (SELECT u, chain, count(*) c FROM p GROUP BY ALL),
i AS (SELECT image_uri_norm img, k.chain, contract_address, token_uri_norm u, coalesce(c > 1, false) own,
  EXISTS (SELECT 1 FROM pc q WHERE q.u = k.token_uri_norm AND q.chain <> k.chain) wide FROM k LEFT JOIN pc ON pc.u = k.token_uri_norm AND pc.chain = k.chain WHERE image_uri_norm <> ''),
ic AS (SELECT img, chain FROM i GROUP BY img, chain HAVING count(DISTINCT contract_address) FILTER (WHERE NOT own) > 1),
iw AS (SELECT img FROM i WHERE NOT wide GROUP BY img HAVING count(DISTINCT chain) > 1),
m AS (SELECT i.img, i.chain a, o.chain b, contract_address FROM i JOIN (SELECT DISTINCT img, chain FROM i) o ON o.img = i.img AND o.chain <> i.chain
  WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.u = i.u AND pc.chain = o.chain)),
h AS (SELECT 'intra' kind, i.chain primary_chain, NULL secondary_chain, contract_address, 1 n FROM i JOIN ic USING (img, chain) WHERE NOT own
  UNION ALL SELECT 'cross', chain, NULL, contract_address, 1 FROM i JOIN iw USING (img) WHERE NOT wide
  UNION ALL SELECT 'matrix', a, b, contract_address, 1 FROM m WHERE EXISTS (SELECT 1 FROM m z WHERE z.img = m.img AND z.a = m.b AND z.b = m.a))"""
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_NAMES = f"""
u AS (SELECT * FROM k WHERE {_STRIP.format("name_norm")} <> '' AND lower({_STRIP.format("name_norm")}) NOT IN ({", ".join(f"'{x}'" for x in text.NO_NAME)}) AND NOT regexp_full_match({_STRIP.format("name_norm")}, '[0-9]')),
b AS (SELECT name_norm name, chain, contract_address, count(*) n FROM u GROUP BY ALL),
z AS (SELECT name, chain, contract_address, n members, n FROM b WHERE chain = 'solana'
  UNION ALL SELECT name, chain, contract_address, 1, s FROM (SELECT chain, contract_address, arg_min(name, (-n, name)) name FROM b WHERE chain <> 'solana' GROUP BY ALL)
    JOIN (SELECT chain, contract_address, count(*) s FROM k GROUP BY ALL) USING (chain, contract_address)),
st AS (SELECT name, chain, sum(members) m FROM z GROUP BY ALL)"""
_LINKS = """
h AS (SELECT 'intra' kind, z.chain primary_chain, NULL secondary_chain, contract_address, z.n FROM z JOIN l ON l.name = z.name AND l.chain = z.chain AND l.peer = z.chain
  UNION ALL SELECT 'matrix', z.chain, l.peer, contract_address, z.n FROM z JOIN l ON l.name = z.name AND l.chain = z.chain AND l.peer <> z.chain
  UNION ALL SELECT 'cross', z.chain, NULL, contract_address, z.n FROM z WHERE EXISTS (SELECT 1 FROM l WHERE l.name = z.name AND l.chain = z.chain AND l.peer <> z.chain))"""
_SAME = "SELECT name, chain, chain peer FROM st WHERE m > 1 UNION SELECT a.name, a.chain, b.chain FROM st a JOIN st b ON a.name = b.name AND a.chain <> b.chain"
_NEAR = f"f AS (SELECT x.name a, y.name b, jaro_winkler_similarity(x.name, y.name) s FROM (SELECT DISTINCT name FROM z) x JOIN (SELECT DISTINCT name FROM z) y ON x.name < y.name WHERE jaro_winkler_similarity(x.name, y.name) >= {NAME_THRESHOLD})"
_TOP = f"""
sb AS (SELECT feed, metric, metric_window, lower(trim(chain)) chain, {_address("chain", "address")} address, min(seed_rank) seed_rank FROM seeds WHERE trim(address) <> '' GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY feed, metric, metric_window, chain ORDER BY seed_rank NULLS LAST, address) position FROM sb QUALIFY position <= {SEEDS_PER_RANKING})"""
_SEEDS = f"sd AS (SELECT DISTINCT lower(trim(chain)) chain, {_address('chain', 'address')} contract_address FROM seeds WHERE trim(chain) <> '' AND trim(address) <> '')"
_SEED_EDGES = """
w AS (SELECT 'token_uri' dimension, token_uri_norm u, * FROM k WHERE token_uri_norm <> '' UNION ALL SELECT 'image_uri', image_uri_norm, * FROM k WHERE image_uri_norm <> ''),
sw AS (SELECT DISTINCT dimension, u, chain, contract_address FROM w SEMI JOIN sd USING (chain, contract_address)),
e AS (SELECT DISTINCT sw.dimension, sw.chain seed_chain, sw.contract_address seed_address, w.chain candidate_chain, w.contract_address candidate_address, token_id FROM w JOIN sw USING (dimension, u)
  WHERE w.chain <> sw.chain OR w.contract_address <> sw.contract_address)"""
_SCALE = """SELECT seed_chain, seed_address, dimension, count(DISTINCT (candidate_chain, candidate_address)) candidate_contracts, count(DISTINCT (candidate_chain, candidate_address, token_id)) candidate_nfts
  FROM (SELECT * FROM {0} UNION ALL SELECT * REPLACE ('total' AS dimension) FROM {0}) GROUP BY ALL"""
_RELATIONS = f"""
r AS (SELECT lower(trim(seed_chain)) seed_chain, {_address("seed_chain", "seed_address")} seed_address, lower(trim(candidate_chain)) candidate_chain, {_address("candidate_chain", "candidate_address")} candidate_address, dimensions, nft_ids FROM seed_relations),
g AS (SELECT * FROM r WHERE seed_address IS NOT NULL AND candidate_address IS NOT NULL AND seed_chain IS NOT NULL AND candidate_chain IS NOT NULL AND (seed_chain <> candidate_chain OR seed_address <> candidate_address)),
uni AS (SELECT seed_chain, seed_address, candidate_chain, candidate_address, array_to_string(list_sort(list_distinct(flatten(list(coalesce(dimensions, []))))), ',') dimensions,
  len(list_distinct(flatten(list(coalesce(nft_ids, []))))) nfts, count(*) reports FROM g GROUP BY ALL)"""
_REST = "ingested_at NULLS LAST, block_ts NULLS FIRST, block_number NULLS FIRST, is_mint NULLS FIRST, gas_native NULLS FIRST, fee_payer NULLS FIRST, mint_payment_native NULLS FIRST, mint_payment_usd NULLS FIRST, mint_payment_receiver NULLS FIRST"
_MOVES = f"""
tidy AS (SELECT lower(trim(chain)) chain, {", ".join(f"{_address('chain', c)} {c}" for c in ("contract_address", "from_address", "to_address", "fee_payer", "mint_payment_receiver", "tx_hash"))},
  token_id, block_ts, block_number, is_mint, gas_native, mint_payment_native, mint_payment_usd, ingested_at FROM transfers),
m AS (SELECT * FROM tidy WHERE contract_address IS NOT NULL AND chain IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chain, contract_address, tx_hash, token_id, from_address, to_address ORDER BY {_REST}) = 1)"""
_GAS = "gas AS (SELECT chain, tx_hash, max(gas_native) gas_native, min(fee_payer) fee_payer, count(*) events FROM m WHERE tx_hash IS NOT NULL GROUP BY ALL)"
_LAST = "held AS (SELECT chain, contract_address, token_id, to_address FROM m WHERE token_id IS NOT NULL AND to_address IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chain, contract_address, token_id ORDER BY block_ts DESC NULLS LAST, block_number DESC NULLS LAST, tx_hash DESC NULLS LAST, to_address DESC) = 1)"
_EDGES = "ed AS (SELECT DISTINCT chain, contract_address, from_address src, to_address dst FROM m WHERE from_address <> to_address)"
_SCC = """reach AS (SELECT chain, contract_address, src, dst FROM ed UNION SELECT r.chain, r.contract_address, r.src, ed.dst FROM reach r JOIN ed ON ed.chain = r.chain AND ed.contract_address = r.contract_address AND ed.src = r.dst),
scc AS (SELECT a.chain, a.contract_address, a.src v, min(a.dst) component FROM reach a JOIN reach b ON a.chain = b.chain AND a.contract_address = b.contract_address AND a.src = b.dst AND a.dst = b.src GROUP BY ALL)"""


def _url(c: str) -> str:
    v = f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"

    def part(x: str, scheme: str) -> str:
        kept = f"trim(regexp_extract({x}, '^[^?#]*'), '/')"
        return f"CASE WHEN {kept} <> '' THEN '{scheme}:' || {kept} ELSE '' END"

    nulls = ", ".join(f"'{x}'" for x in text.NO_URI)
    return f"""CASE WHEN {v} = '' OR lower({v}) IN ({nulls}) OR lower({v}) LIKE 'data:%' THEN ''
        WHEN lower({v}) LIKE 'ipfs://%' THEN {part(f"regexp_replace(substring({v}, 8), '(?i)^ipfs/', '')", "ipfs")} WHEN lower({v}) LIKE 'ar://%' THEN {part(f"substring({v}, 6)", "ar")}
        WHEN regexp_extract({v}, '{text.IPFS_GATEWAY}', 1) <> '' THEN {part(f"regexp_extract({v}, '{text.IPFS_GATEWAY}', 1)", "ipfs")}
        WHEN regexp_extract({v}, '{text.ARWEAVE_GATEWAY}', 1) <> '' THEN {part(f"regexp_extract({v}, '{text.ARWEAVE_GATEWAY}', 1)", "ar")}
        ELSE rtrim(lower({v}), '/') END"""


_FIRST_TEXTS = f"""
raw AS (SELECT row_id, lower(trim(chain)) chain, {_address("chain", "contract_address")} contract_address, trim(token_id) token_id, lower(trim(metadata_json)) t FROM snapshot
  WHERE trim(chain) <> '' AND trim(contract_address) <> '' AND trim(token_id) <> '' AND trim(metadata_json) <> ''),
ax AS (SELECT chain, contract_address, token_id, arg_min(t, row_id) t FROM raw GROUP BY ALL),
an AS (SELECT ax.*, chain <> 'solana' al, CASE WHEN regexp_full_match(token_id, '[0-9]+') THEN 0 ELSE 1 END d, CASE WHEN regexp_full_match(token_id, '[0-9]+') THEN regexp_replace(token_id, '^0+(.)', '\\1') ELSE token_id END p FROM ax),
ar AS (SELECT *, (d, CASE WHEN d = 0 THEN length(p) ELSE 0 END, p) o FROM an)"""


def _text_match(unit: str) -> str:
    """SQL of the matching pairs (a, b, s) of units (id u, chain, contract_address) over _FIRST_TEXTS."""
    return f"""
un AS (SELECT *, {unit} unit FROM ar), ui AS (SELECT chain, contract_address, unit, any_value(al) al, arg_max(t, (o, token_id)) top FROM un GROUP BY ALL),
us AS (SELECT *, row_number() OVER (ORDER BY chain, contract_address, unit) u FROM ui), ua AS (SELECT u, token_id, o, t, un.al FROM un JOIN us USING (chain, contract_address, unit)),
cm AS (SELECT x.u a, y.u b, arg_max(x.t, (x.o, x.token_id)) ta, arg_max(y.t, (x.o, x.token_id)) tb FROM ua x JOIN ua y ON x.token_id = y.token_id AND x.u < y.u AND x.al AND y.al GROUP BY ALL),
pr AS (SELECT x.u a, y.u b, coalesce(cm.ta, x.top) ta, coalesce(cm.tb, y.top) tb FROM us x JOIN us y ON x.u < y.u LEFT JOIN cm ON cm.a = x.u AND cm.b = y.u),
dd AS (SELECT DISTINCT ta x, tb y FROM pr WHERE ta < tb UNION SELECT DISTINCT tb, ta FROM pr WHERE tb < ta),
dt AS (SELECT t, row_number() OVER (ORDER BY t) i FROM (SELECT DISTINCT t FROM ar)),
tf AS (SELECT i, term, count(*) n FROM (SELECT i, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')) term FROM dt) GROUP BY ALL), ln AS (SELECT i, sum(n) l FROM tf GROUP BY i),
di AS (SELECT a.i x, b.i y FROM dd JOIN dt a ON a.t = x JOIN dt b ON b.t = y),
al2 AS (SELECT x, y, lx.l lx, ly.l ly, greatest((lx.l + ly.l) / 2, 1.0) av FROM di JOIN ln lx ON lx.i = x JOIN ln ly ON ly.i = y),
xw AS (SELECT x, y, term, n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lx / av)) w FROM al2 JOIN tf ON tf.i = x),
yw AS (SELECT x, y, term, n * 2.2 / (n + 1.2 * (0.25 + 0.75 * ly / av)) w FROM al2 JOIN tf ON tf.i = y),
bo AS (SELECT x, y, coalesce(xw.w, 0) a, coalesce(yw.w, 0) b, CASE WHEN xw.w IS NULL OR yw.w IS NULL THEN ln(2.0) ELSE ln(1.2) END idf FROM xw FULL JOIN yw USING (x, y, term)),
sc AS (SELECT x, y, sum(idf * idf * a * b) / sqrt(sum(idf * idf * a * a) * sum(idf * idf * b * b)) s FROM bo GROUP BY ALL),
st2 AS (SELECT a.t x, b.t y, s FROM sc JOIN dt a ON a.i = sc.x JOIN dt b ON b.i = sc.y),
mt AS (SELECT a, b, CASE WHEN ta = tb THEN 1.0 ELSE s END s FROM pr LEFT JOIN st2 ON x = least(ta, tb) AND y = greatest(ta, tb) WHERE ta = tb OR s >= {METADATA_THRESHOLD})"""


_CONTRACTS, _UNITS = "''", "CASE WHEN al THEN '' ELSE token_id END"
_TEXT_SCOPES = f"""
sz AS (SELECT chain, contract_address, count(*) n FROM k GROUP BY ALL),
mb AS (SELECT u, us.chain, us.contract_address, CASE WHEN us.al THEN sz.n ELSE 1 END n FROM us JOIN sz USING (chain, contract_address)),
h AS (SELECT DISTINCT kind, m.chain primary_chain, CASE WHEN kind = 'matrix' THEN p.chain END secondary_chain, m.contract_address, m.u, m.n FROM mb m JOIN (SELECT a, b FROM {{}} UNION ALL SELECT b, a FROM {{}}) e ON e.a = m.u JOIN mb p ON p.u = e.b
  JOIN (VALUES ('intra'), ('cross'), ('matrix')) v(kind) ON (kind = 'intra') = (m.chain = p.chain))"""

ORACLES = {
    "snapshot_tokens": f"WITH {_CLEAN} SELECT * FROM k",
    "snapshot_totals": f"WITH {_CLEAN}, {_TOTALS} SELECT * FROM t",
    "snapshot_one_chain": f"WITH {_CLEAN} SELECT contract_address, count(*) n, count(DISTINCT token_uri_norm) uris FROM c WHERE chain = 'base' GROUP BY ALL",
    "snapshot_conflicts": f"""WITH {_CLEAN}, x AS (SELECT chain, contract_address, token_id, 'token_uri_norm' field_name, token_uri_norm v FROM c UNION ALL SELECT chain, contract_address, token_id, 'image_uri_norm', image_uri_norm FROM c)
        SELECT chain, contract_address, token_id, field_name, count(DISTINCT v) uris FROM x WHERE v <> '' GROUP BY ALL HAVING count(DISTINCT v) > 1""",
    "highest_tokens": f"""WITH {_CLEAN}, n AS (SELECT *, regexp_full_match(token_id, '[0-9]+') d, CASE WHEN regexp_full_match(token_id, '[0-9]+') THEN regexp_replace(token_id, '^0+(.)', '\\1') ELSE token_id END p FROM c)
        SELECT chain, contract_address, p token_id FROM n QUALIFY row_number() OVER (PARTITION BY chain, contract_address ORDER BY d, CASE WHEN d THEN length(p) ELSE 0 END DESC, p DESC) = 1""",
    "url_forms": f"""WITH x AS (SELECT asset_id, image_uri, {_url("token_uri")} token_uri_norm, {_url("image_uri")} image_uri_norm FROM nft_assets)
        SELECT asset_id, token_uri_norm, image_uri_norm, nullif(lower(regexp_extract(regexp_extract(image_uri, '^[^?#]*'), '\\.([A-Za-z0-9]{{1,5}})$', 1)), '') suffix,
        CASE WHEN image_uri_norm LIKE 'ipfs:%' THEN 'https://ipfs.io/ipfs/' || regexp_replace(image_uri_norm, '^ipfs:/*', '') WHEN image_uri_norm LIKE 'ar:%' THEN 'https://arweave.net/' || regexp_replace(image_uri_norm, '^ar:/*', '') ELSE image_uri_norm END image_url FROM x""",
    "export_counts": f"""SELECT lower(trim(chain)) chain, count(*) n, count(*) FILTER (WHERE trim(contract_address) <> '') contract_address, count(*) FILTER (WHERE {_url("token_uri")} <> '') token_uri_norm,
        count(*) FILTER (WHERE {_url("image_uri")} <> '') image_uri_norm, count(*) FILTER (WHERE metadata <> '') metadata_json FROM nft_assets GROUP BY 1""",
    "token_uri_scopes": f"WITH {_CLEAN}, {_SHARED} {_COUNTED.format('token_uri')}",
    "token_uri_ratios": f"""WITH {_CLEAN}, {_TOTALS}, {_SHARED}, q AS ({_COUNTED.format("token_uri")}) SELECT kind, primary_chain, secondary_chain, round(duplicate_contract_count / contracts, 9) contract_ratio,
        round(duplicate_nft_count / nfts, 9) nft_ratio FROM q JOIN t ON t.chain = primary_chain""",
    "image_uri_scopes": f"WITH {_CLEAN}, {_IMAGES} {_COUNTED.format('image_uri')}",
    "name_bearers": f"WITH {_CLEAN}, {_NAMES} SELECT * FROM z",
    "exact_name_scopes": f"WITH {_CLEAN}, {_NAMES}, l AS ({_SAME}), {_LINKS} {_COUNTED.format('name')}",
    "fuzzy_name_pairs": f"WITH {_CLEAN}, {_NAMES}, {_NEAR} SELECT a, b, round(s, 9) similarity FROM f",
    "fuzzy_name_scopes": f"""WITH {_CLEAN}, {_NAMES}, {_NEAR}, fb AS (SELECT a, b FROM f UNION ALL SELECT b, a FROM f),
        l AS ({_SAME} UNION SELECT x.name, x.chain, y.chain FROM st x JOIN fb ON fb.a = x.name JOIN st y ON y.name = fb.b), {_LINKS} {_COUNTED.format("name")}""",
    "text_pairs": f"WITH {_CLEAN}, {_FIRST_TEXTS}, {_text_match(_CONTRACTS)} SELECT x.chain chain_a, x.contract_address contract_a, y.chain chain_b, y.contract_address contract_b, round(s, 6) score FROM mt JOIN us x ON x.u = a JOIN us y ON y.u = b",
    "text_scopes": f"WITH {_CLEAN}, {_FIRST_TEXTS}, {_text_match(_UNITS)}, {_TEXT_SCOPES.format('mt', 'mt')} {_COUNTED.format('metadata')}",
    "text_scopes_of_all": f"""WITH {_CLEAN}, {_FIRST_TEXTS}, us AS (SELECT *, row_number() OVER (ORDER BY chain, contract_address, unit) u FROM (SELECT DISTINCT chain, contract_address, al, {_UNITS} unit FROM ar)),
        mt AS (SELECT x.u a, y.u b FROM us x JOIN us y ON x.u < y.u), {_TEXT_SCOPES.format("mt", "mt")} {_COUNTED.format("metadata")}""",
    "text_profiles": f"""WITH {_FIRST_TEXTS}, un AS (SELECT *, {_UNITS} unit FROM ar), pf AS (SELECT chain, contract_address, unit, al, CASE WHEN any_value(al) THEN list_sort(list((token_id, t))) ELSE [('', arg_max(t, (o, token_id)))] END l FROM un GROUP BY ALL)
        SELECT chain, contract_address, unit, al aligned, members FROM (SELECT *, row_number() OVER w i, count(*) OVER (PARTITION BY al, l) members FROM pf WINDOW w AS (PARTITION BY al, l ORDER BY chain, contract_address, unit)) WHERE i = 1""",
    "lowest_anchors": f"""WITH {_FIRST_TEXTS}, fr AS (SELECT chain, contract_address, token_id, min(row_id) row_id FROM raw GROUP BY ALL), oa AS (SELECT ar.*, row_id FROM ar JOIN fr USING (chain, contract_address, token_id))
        SELECT chain, contract_address, token_id, 'low' AS "end", row_id FROM oa QUALIFY row_number() OVER (PARTITION BY chain, contract_address ORDER BY o, token_id) <= 3
        UNION ALL SELECT chain, contract_address, token_id, 'high', row_id FROM oa QUALIFY row_number() OVER (PARTITION BY chain, contract_address ORDER BY o DESC, token_id DESC) <= 2""",
    "seed_tokens": f"WITH {_CLEAN}, {_SEEDS} SELECT chain, contract_address, token_id, first_row row_id FROM k SEMI JOIN sd USING (chain, contract_address)",
    "seed_hits": f"""WITH {_CLEAN}, {_NAMES}, {_NEAR}, {_SEEDS}, tm AS (WITH {_FIRST_TEXTS}, {_text_match(_CONTRACTS)} SELECT x.chain ca, x.contract_address xa, y.chain cb, y.contract_address xb FROM mt JOIN us x ON x.u = a JOIN us y ON y.u = b),
        {_SEED_EDGES}, sn AS (SELECT DISTINCT z.chain, z.contract_address, name FROM z SEMI JOIN sd USING (chain, contract_address)),
        nw AS (SELECT chain, contract_address, name FROM sn UNION SELECT chain, contract_address, b FROM sn JOIN f ON a = name UNION SELECT chain, contract_address, a FROM sn JOIN f ON b = name),
        wh AS (SELECT DISTINCT 'name' dimension, nw.chain seed_chain, nw.contract_address seed_address, z.chain candidate_chain, z.contract_address candidate_address FROM nw JOIN z USING (name)
          UNION ALL SELECT 'metadata', ca, xa, cb, xb FROM tm SEMI JOIN sd ON sd.chain = ca AND sd.contract_address = xa UNION ALL SELECT 'metadata', cb, xb, ca, xa FROM tm SEMI JOIN sd ON sd.chain = cb AND sd.contract_address = xb),
        al3 AS (SELECT * FROM e UNION ALL SELECT wh.*, k.token_id FROM wh JOIN k ON k.chain = candidate_chain AND k.contract_address = candidate_address WHERE seed_chain <> candidate_chain OR seed_address <> candidate_address)
        {_SCALE.format("al3")}""",
    "seed_text_hits": f"""WITH {_CLEAN}, {_FIRST_TEXTS}, {_text_match(_CONTRACTS)}, {_SEEDS}, w AS (SELECT a, b, s FROM mt UNION ALL SELECT b, a, s FROM mt)
        SELECT x.chain, x.contract_address, y.chain peer_chain, y.contract_address peer_address, round(s, 6) score FROM w JOIN us x ON x.u = a JOIN us y ON y.u = b WHERE EXISTS (SELECT 1 FROM sd WHERE sd.chain = x.chain AND sd.contract_address = x.contract_address)""",
    "ranked_seeds": f"WITH {_TOP} SELECT * FROM top",
    "seed_uri_scale": f"WITH {_CLEAN}, {_SEEDS}, {_SEED_EDGES} {_SCALE.format('e')}",
    "seed_uri_scale_images_apart": f"""WITH {_CLEAN}, {_SEEDS}, {_SEED_EDGES}, ap AS (SELECT * FROM e WHERE dimension = 'token_uri' OR NOT EXISTS (SELECT 1 FROM e x WHERE x.dimension = 'token_uri' AND x.seed_chain = e.seed_chain
        AND x.seed_address = e.seed_address AND x.candidate_chain = e.candidate_chain AND x.candidate_address = e.candidate_address AND x.token_id = e.token_id)) {_SCALE.format("ap")}""",
    "seed_name_hits": f"""WITH {_CLEAN}, {_NAMES}, {_NEAR}, {_SEEDS}, sn AS (SELECT DISTINCT z.chain, z.contract_address, name FROM z SEMI JOIN sd USING (chain, contract_address)),
        w AS (SELECT chain, contract_address, name, 1.0 s FROM sn UNION ALL SELECT chain, contract_address, b, s FROM sn JOIN f ON a = name UNION ALL SELECT chain, contract_address, a, s FROM sn JOIN f ON b = name)
        SELECT w.chain seed_chain, w.contract_address seed_address, z.chain candidate_chain, z.contract_address candidate_address, round(max(s), 9) score FROM w JOIN z USING (name)
        WHERE w.chain <> z.chain OR w.contract_address <> z.contract_address GROUP BY ALL""",
    "snapshot_report": f"""WITH {_CLEAN}, {_TOTALS}, n AS (WITH {_NAMES}, l AS ({_SAME}), {_LINKS} {_COUNTED.format("name")}), u AS (WITH {_SHARED} {_COUNTED.format("token_uri")}), i AS (WITH {_IMAGES} {_COUNTED.format("image_uri")}),
        a AS (SELECT * FROM n UNION ALL SELECT * FROM u UNION ALL SELECT * FROM i) SELECT a.*, round(duplicate_contract_count / contracts, 9) contract_ratio, round(duplicate_nft_count / nfts, 9) nft_ratio FROM a JOIN t ON t.chain = primary_chain""",
    "repeated_addresses": f"""WITH {_MOVES}, e AS (SELECT chain, contract_address, from_address address FROM m UNION SELECT chain, contract_address, to_address FROM m)
        SELECT chain, address, count(*) contracts FROM e WHERE address IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
    "cycle_exits": f"""WITH RECURSIVE {_MOVES}, {_EDGES}, {_SCC}, x AS (SELECT m.chain, m.contract_address, a.component, m.block_ts, coalesce(b.component = a.component, false) AS inside FROM m
          JOIN scc a ON a.chain = m.chain AND a.contract_address = m.contract_address AND a.v = m.from_address LEFT JOIN scc b ON b.chain = m.chain AND b.contract_address = m.contract_address AND b.v = m.to_address
          WHERE m.block_ts IS NOT NULL AND m.to_address IS NOT NULL AND m.from_address <> m.to_address),
        e AS (SELECT chain, contract_address, component, max(block_ts) ended_at, count(*) inner_moves FROM x WHERE inside GROUP BY ALL)
        SELECT e.*, min(block_ts) first_exit_at, count(block_ts) exits FROM e LEFT JOIN x ON x.chain = e.chain AND x.contract_address = e.contract_address AND x.component = e.component AND NOT inside AND x.block_ts > ended_at GROUP BY ALL""",
    "relations_unified": f"WITH {_RELATIONS} SELECT * FROM uni",
    "relations_by_scope": f"""WITH {_RELATIONS}, s AS (SELECT *, unnest(CASE WHEN seed_chain = candidate_chain THEN [{{'scope': 'all', 'p': NULL, 's': NULL}}, {{'scope': 'intra', 'p': NULL, 's': NULL}}, {{'scope': 'intra_chain', 'p': seed_chain, 's': NULL}}]
        ELSE [{{'scope': 'all', 'p': NULL, 's': NULL}}, {{'scope': 'cross', 'p': NULL, 's': NULL}}, {{'scope': 'cross_primary', 'p': seed_chain, 's': NULL}}, {{'scope': 'matrix', 'p': seed_chain, 's': candidate_chain}}] END) x FROM uni)
        SELECT x.scope scope, x.p primary_chain, x.s secondary_chain, count(DISTINCT (seed_chain, seed_address)) seeds, count(DISTINCT (candidate_chain, candidate_address)) candidates, count(*) relations FROM s GROUP BY ALL""",
    "sampled_relations": f"""WITH {_RELATIONS} SELECT seed_chain, candidate_chain, seed_address, candidate_address, row_number() OVER (PARTITION BY seed_chain, candidate_chain
        ORDER BY sha256('7|' || seed_address || '|' || candidate_address), seed_address, candidate_address) rank FROM uni QUALIFY rank <= 5""",
    "retry_images": "SELECT token_uri, min(created_at) checked_at FROM nft_assets WHERE trim(coalesce(image_uri, '')) = '' AND trim(coalesce(token_uri, '')) <> '' GROUP BY ALL ORDER BY checked_at NULLS FIRST, token_uri LIMIT 100",
    "staged_assets": f"""SELECT lower(trim(chain)) chain, {_address("chain", "contract_address")} contract_address, token_id, asset_id FROM nft_assets WHERE chain IS NOT NULL AND trim(contract_address) <> '' AND token_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY 1, lower(trim(nft_assets.chain)), {_address("nft_assets.chain", "nft_assets.contract_address")}, token_id ORDER BY created_at NULLS LAST, asset_id) = 1""",
    "filled_assets": f"""WITH {_CLEAN}, f AS (SELECT lower(trim(chain)) chain, {_address("chain", "contract_address")} contract_address, token_id, min(nullif({_url("token_uri")}, '')) token_uri, min(nullif({_url("image_uri")}, '')) image_uri
          FROM nft_assets WHERE trim(contract_address) <> '' AND token_id <> '' GROUP BY ALL)
        SELECT chain, contract_address, token_id, coalesce(nullif(token_uri_norm, ''), token_uri) token_uri, coalesce(nullif(image_uri_norm, ''), image_uri) image_uri FROM k FULL JOIN f USING (chain, contract_address, token_id)""",
    "unlisted_tokens": f"WITH {_CLEAN}, {_SEEDS} SELECT chain, count(*) nfts FROM k ANTI JOIN sd USING (chain, contract_address) GROUP BY chain",
    "transfer_lifecycles": f"""WITH {_MOVES} SELECT chain, contract_address, count(*) events, count(DISTINCT token_id) tokens, count(*) FILTER (WHERE is_mint) mints, min(block_ts) first_at, max(block_ts) last_at,
        min(block_ts) FILTER (WHERE is_mint) first_mint_at, min(block_ts) FILTER (WHERE NOT coalesce(is_mint, false)) first_transfer_at FROM m GROUP BY ALL""",
    "token_holders": f"WITH {_MOVES}, {_LAST} SELECT chain, contract_address, token_id, to_address owner FROM held",
    "first_disposals": f"""WITH {_MOVES} SELECT a.chain, a.contract_address, a.token_id, a.to_address address, a.block_ts acquired_at, (SELECT min(b.block_ts) FROM m b WHERE b.chain = a.chain AND b.contract_address = a.contract_address
        AND b.token_id = a.token_id AND b.from_address = a.to_address AND b.block_ts > a.block_ts) disposed_at FROM m a WHERE a.block_ts IS NOT NULL AND a.token_id IS NOT NULL AND a.to_address IS NOT NULL""",
    "paid_and_held": f"""WITH {_MOVES}, {_LAST} SELECT DISTINCT chain, contract_address, to_address address, token_id FROM m WHERE is_mint AND (mint_payment_native > 0 OR mint_payment_usd > 0)
        AND EXISTS (SELECT 1 FROM held h WHERE h.chain = m.chain AND h.contract_address = m.contract_address AND h.token_id = m.token_id AND h.to_address = m.to_address)""",
    "transaction_gas": f"WITH {_MOVES}, {_GAS} SELECT * FROM gas",
    "mint_payments": f"""WITH {_MOVES} SELECT chain, tx_hash, to_address buyer, count(*) mints, round(sum(mint_payment_native), 6) paid_native,
        CASE WHEN min(mint_payment_receiver) = max(mint_payment_receiver) THEN min(mint_payment_receiver) END receiver FROM m WHERE is_mint AND tx_hash IS NOT NULL GROUP BY chain, tx_hash, to_address""",
    "gas_concentration": f"""WITH {_MOVES}, {_GAS}, p AS (SELECT chain, fee_payer, round(sum(gas_native), 9) g FROM gas WHERE fee_payer IS NOT NULL AND gas_native IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY g DESC, fee_payer) i, count(*) OVER (PARTITION BY chain) n FROM p)
        SELECT chain, max(n) members, CAST(max(ceil(n * 0.1)) AS BIGINT) top_members, round(sum(g) FILTER (WHERE i <= ceil(n * 0.1)) / sum(g), 6) share FROM r GROUP BY chain""",
    "receipt_gini": f"""WITH {_MOVES}, g AS (SELECT chain, contract_address, to_address, count(*) n FROM m WHERE to_address IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY chain, contract_address ORDER BY n) i, count(*) OVER (PARTITION BY chain, contract_address) k FROM g)
        SELECT chain, contract_address, max(k) members, round(sum((2 * i - k - 1) * n) / (max(k) * sum(n)), 9) gini FROM r GROUP BY ALL""",
    "nearest_moves": f"""WITH {_MOVES}, e AS (SELECT chain, contract_address, chain || ':' || to_address AS owner, block_number AS pos FROM m WHERE to_address IS NOT NULL AND block_number IS NOT NULL),
        s AS (SELECT chain, contract_address, owner, min(pos) AS "first", max(pos) AS "last" FROM e GROUP BY ALL)
        SELECT s.*, (SELECT max(e.pos) FROM e WHERE e.owner = s.owner AND e.pos < s."first" AND e.pos >= s."first" - 50000) AS "before", (SELECT min(e.pos) FROM e WHERE e.owner = s.owner AND e.pos > s."last" AND e.pos <= s."last" + 50000) AS "after" FROM s""",
    "address_edges": f"WITH {_MOVES}, {_EDGES} SELECT * FROM ed",
    "trading_cycles": f"WITH RECURSIVE {_MOVES}, {_EDGES}, {_SCC} SELECT chain, contract_address, component, v FROM scc",
    "cycle_sizes": f"WITH RECURSIVE {_MOVES}, {_EDGES}, {_SCC}, s AS (SELECT chain, contract_address, component, count(*) n FROM scc GROUP BY ALL) SELECT CASE WHEN n >= 5 THEN '5+' ELSE CAST(n AS VARCHAR) END size_class, count(*) groups, CAST(sum(n) AS BIGINT) addresses FROM s GROUP BY ALL",
    "fan_addresses": f"""WITH {_MOVES}, {_EDGES} SELECT chain, contract_address, src address, 'out' direction, count(*) others FROM ed GROUP BY ALL HAVING count(*) >= 3
        UNION ALL SELECT chain, contract_address, dst, 'in', count(*) FROM ed GROUP BY ALL HAVING count(*) >= 3""",
    "inventory_shares": f"""WITH {_MOVES}, {_EDGES}, i AS (SELECT chain, contract_address, dst address, count(*) sources FROM ed GROUP BY ALL HAVING count(*) >= 3),
        a AS (SELECT chain, contract_address, count(DISTINCT token_id) n FROM m GROUP BY ALL), h AS (SELECT chain, contract_address, to_address address, count(DISTINCT token_id) tokens FROM m GROUP BY ALL)
        SELECT chain, contract_address, address, sources, tokens, round(tokens / n, 9) token_share, round(coalesce(paid, 0.0) / all_paid, 9) value_share
        FROM i JOIN h USING (chain, contract_address, address) JOIN a USING (chain, contract_address) LEFT JOIN (SELECT chain, contract_address, mint_payment_receiver address, sum(mint_payment_native) paid FROM m WHERE mint_payment_native > 0 AND mint_payment_receiver IS NOT NULL GROUP BY ALL) USING (chain, contract_address, address)
        LEFT JOIN (SELECT chain, contract_address, sum(mint_payment_native) all_paid FROM m WHERE mint_payment_native > 0 AND mint_payment_receiver IS NOT NULL GROUP BY ALL) USING (chain, contract_address)""",
    "inserted_assets": """WITH x AS (SELECT asset_id, chain, contract_address, token_id, asset_name, asset_id % 2 e FROM nft_assets WHERE chain IS NOT NULL AND contract_address IS NOT NULL AND token_id IS NOT NULL),
        f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY chain, contract_address, token_id, e ORDER BY asset_id) = 1)
        SELECT asset_id, chain, contract_address, token_id, CASE WHEN e = 0 THEN substring(asset_name, 1, 10) ELSE asset_name END asset_name FROM f WHERE e = 1 OR NOT EXISTS (SELECT 1 FROM f o WHERE o.e = 1 AND o.chain = f.chain AND o.contract_address = f.contract_address AND o.token_id = f.token_id)""",
    "usable_assets": """WITH x AS (SELECT asset_id, chain, contract_address, CASE WHEN asset_id % 97 = 0 THEN 'data:image/png;base64,AA' WHEN asset_id % 2 = 0 THEN 'ipfs://p/' || asset_id ELSE image_uri END image_uri,
          CASE WHEN asset_id % 2 = 0 THEN 'data:application/json;base64,' || base64(CAST('{"image":"ipfs://p/' || asset_id || '"}' AS BLOB)) ELSE token_uri END token_uri FROM nft_assets WHERE chain IS NOT NULL AND contract_address IS NOT NULL)
        SELECT asset_id, image_uri, length(token_uri) uri_length FROM x WHERE token_uri <> '' AND token_uri NOT LIKE 'ar://%' AND NOT EXISTS (SELECT 1 FROM x y WHERE y.chain = x.chain AND y.contract_address = x.contract_address AND y.image_uri LIKE 'data:image%')""",
    "block_range": """WITH b AS (SELECT min(first_seen_block) lo, max(first_seen_block) hi FROM snapshot) SELECT lower(trim(chain)) chain, count(*) n FROM snapshot, b WHERE first_seen_block BETWEEN lo + (hi - lo) // 4 AND hi - (hi - lo) // 4 GROUP BY 1""",
    "layered_paths": f"""WITH {_MOVES}, st AS (SELECT chain, address FROM (SELECT DISTINCT chain, contract_address, unnest([from_address, to_address]) address FROM m) WHERE address IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
        v AS (SELECT *, row_number() OVER (ORDER BY block_number NULLS FIRST, block_ts NULLS FIRST, tx_hash NULLS FIRST, to_address) o FROM (SELECT DISTINCT chain, contract_address, token_id, from_address, to_address, block_number, block_ts, tx_hash FROM m WHERE token_id <> '' AND from_address <> '' AND to_address <> '')),
        w AS (SELECT a.chain, a.contract_address, a.token_id, a.from_address AS "start", a.from_address || '>' || a.to_address || '>' || b.to_address path, a.block_number first_block, b.block_number last_block, row_number() OVER (PARTITION BY a.chain, a.contract_address, a.token_id, a.from_address ORDER BY a.o, b.o) i
          FROM v a SEMI JOIN st ON st.chain = a.chain AND st.address = a.from_address JOIN v b ON b.chain = a.chain AND b.contract_address = a.contract_address AND b.token_id = a.token_id AND b.from_address = a.to_address
          WHERE a.from_address <> a.to_address AND b.to_address NOT IN (a.from_address, a.to_address) AND CASE WHEN a.block_number IS NOT NULL AND b.block_number IS NOT NULL THEN a.block_number < b.block_number ELSE a.block_ts < b.block_ts END)
        SELECT chain, contract_address, token_id, "start", 2 hops, path, first_block, last_block FROM w WHERE i = 1""",
    "cycle_instances": f"""WITH RECURSIVE {_MOVES}, {_EDGES}, {_SCC}, x AS (SELECT m.*, a.component FROM m JOIN scc a ON a.chain = m.chain AND a.contract_address = m.contract_address AND a.v = m.from_address JOIN scc b ON b.chain = m.chain AND b.contract_address = m.contract_address AND b.v = m.to_address AND b.component = a.component WHERE from_address <> to_address)
        SELECT chain, contract_address, component, count(*) events, count(DISTINCT from_address) addresses, count(DISTINCT token_id) tokens, min(block_ts) first_at, max(block_ts) last_at, min(block_number) first_block, max(block_number) last_block, round(sum(greatest(0.0, coalesce(gas_native, 0.0))), 9) "value" FROM x GROUP BY ALL""",
    "licensed_documents": """WITH x AS (SELECT asset_id, CASE asset_id % 3 WHEN 0 THEN '{"license":"CC0-1.0 ","m":' || metadata || '}' WHEN 1 THEN '{"public domain":"no","m":' || metadata || '}' ELSE metadata END t FROM nft_assets WHERE metadata IS NOT NULL)
        SELECT asset_id, json_valid(t) AND asset_id % 3 = 0 AS "open" FROM x""",
    "seed_uri_scale_by_scope": f"""WITH {_CLEAN}, {_SEEDS}, {_SEED_EDGES}, t AS (SELECT * FROM e UNION ALL SELECT * REPLACE ('total' AS dimension) FROM e),
        s AS (SELECT *, unnest(CASE WHEN seed_chain = candidate_chain THEN [{{'s': 'total', 'c': NULL}}, {{'s': 'intra', 'c': NULL}}] ELSE [{{'s': 'total', 'c': NULL}}, {{'s': 'cross', 'c': NULL}}, {{'s': 'matrix', 'c': candidate_chain}}] END) x FROM t)
        SELECT seed_chain, seed_address, x.s scope, x.c secondary_chain, dimension, count(DISTINCT (candidate_chain, candidate_address)) candidate_contracts, count(DISTINCT (candidate_chain, candidate_address, token_id)) candidate_nfts FROM s GROUP BY ALL""",
    "sampled_in_scopes": f"""WITH {_RELATIONS}, x AS (SELECT *, unnest(CASE WHEN seed_chain = candidate_chain THEN [{{'s': 'all', 'a': NULL, 'b': NULL}}, {{'s': 'intra', 'a': seed_chain, 'b': NULL}}] ELSE [{{'s': 'all', 'a': NULL, 'b': NULL}},
          {{'s': 'pair', 'a': least(seed_chain, candidate_chain), 'b': greatest(seed_chain, candidate_chain)}}, {{'s': 'cross', 'a': seed_chain, 'b': NULL}}, {{'s': 'cross', 'a': candidate_chain, 'b': NULL}}] END) x FROM uni)
        SELECT x.s scope, x.a chain, x.b "other", seed_chain, seed_address, candidate_chain, candidate_address, row_number() OVER (PARTITION BY x.s, x.a, x.b ORDER BY sha256('7|' || seed_chain || '|' || seed_address || '|' || candidate_chain || '|' || candidate_address)) rank FROM x QUALIFY rank <= 4""",
    "sampled_group_pairs": f"WITH {_CLEAN}, {_NAMES}, x AS (SELECT name, count(DISTINCT (chain, contract_address)) n FROM z GROUP BY name) SELECT name, least(20, n * (n - 1) // 2) pairs, least(20, n * (n - 1) // 2) different FROM x WHERE n > 1",
    "names_by_length": f"WITH {_CLEAN}, {_NAMES} SELECT chain, name, row_number() OVER (PARTITION BY chain ORDER BY length(name), name) rank FROM (SELECT DISTINCT chain, name FROM z)",
    "unexcluded_tokens": f"""WITH {_CLEAN}, x AS (SELECT DISTINCT lower(trim(chain)) chain, {_address("chain", "contract_address")} contract_address FROM nft_assets WHERE lower(token_standard) = 'erc1155') SELECT chain, count(*) nfts FROM k ANTI JOIN x USING (chain, contract_address) GROUP BY chain""",
    "overlaid_tokens": f"""WITH {_CLEAN}, {_SEEDS}, l AS (SELECT DISTINCT lower(trim(chain)) chain, {_address("chain", "contract_address")} contract_address, token_id FROM nft_assets WHERE trim(chain) <> '' AND trim(contract_address) <> '' AND token_id <> ''), ls AS (SELECT l.* FROM l SEMI JOIN sd USING (chain, contract_address)),
        u AS (SELECT chain, contract_address, token_id FROM k ANTI JOIN ls USING (chain, contract_address) UNION ALL SELECT * FROM ls) SELECT chain, contract_address, count(*) nfts FROM u GROUP BY ALL""",
    "token_handovers": f"""WITH {_MOVES}, o AS (SELECT *, row_number() OVER w i, CASE WHEN from_address IS NOT DISTINCT FROM lag(to_address) OVER w THEN 0 ELSE 1 END b FROM m
          WHERE token_id IS NOT NULL AND block_ts IS NOT NULL AND from_address IS NOT NULL AND to_address IS NOT NULL
          WINDOW w AS (PARTITION BY chain, contract_address, token_id ORDER BY block_ts, block_number NULLS FIRST, tx_hash NULLS FIRST, from_address, to_address)),
        p AS (SELECT *, sum(b) OVER (PARTITION BY chain, contract_address, token_id ORDER BY i) g FROM o),
        q AS (SELECT chain, contract_address, token_id, CAST(g AS BIGINT) path_no, count(*) hops, list_concat([arg_min(from_address, i)], list(to_address ORDER BY i)) a FROM p GROUP BY ALL)
        SELECT chain, contract_address, token_id, path_no, hops, len(list_distinct(a)) addresses, array_to_string(a, '>') path FROM q WHERE len(list_distinct(a)) >= 3""",
    "streamed_daily_counts": "SELECT lower(trim(chain)) chain, strftime(ingested_at, '%Y-%m-%d') AS day, count(*) records, max(first_seen_block) highest_block FROM snapshot WHERE ingested_at IS NOT NULL GROUP BY ALL",
    "streamed_tokens": f"SELECT lower(trim(chain)) chain, count(DISTINCT ({_address('chain', 'contract_address')}, token_id)) nfts FROM snapshot WHERE chain IS NOT NULL AND trim(contract_address) <> '' AND token_id IS NOT NULL GROUP BY 1",
}


def _base58(n: int) -> str:
    return text.base58_encode(n.to_bytes(32, "big"))


def _name_norm() -> str:
    """SQL of tables n0 ... with (asset_id, n): the name, its numbered ends taken off one after another."""
    strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    parts = [f"n0 AS (SELECT asset_id, {strip.format("regexp_replace(asset_name, '\\s+', ' ', 'g')")} n FROM nft_assets)"]
    for i in range(4):
        cases = " ".join("WHEN {0} <> n THEN {0}".format(strip.format(f"regexp_replace(n, '{p}', '')")) for p in text.NUMBERED_ENDS)
        parts.append(f"n{i + 1} AS (SELECT asset_id, CASE {cases} ELSE n END n FROM n{i})")
    return ", ".join(parts)


_VALID = "left(trim({0}), 1) IN ('{{', '[') AND json_valid(trim({0})) AND strlen(trim({0})) <= 65536 AND NOT regexp_full_match(trim({0}), '\\{{\\s*\\}}') AND NOT regexp_matches(trim({0}), '[:\\[,]\\s*-?(NaN|Infinity)')"
_PLAIN = "lower(regexp_replace(regexp_replace({}, '\\s+', ' ', 'g'), '^ | $', '', 'g'))"
_CANON = f"""
vd AS (SELECT asset_id, CAST(trim(metadata) AS JSON) j FROM nft_assets WHERE {_VALID.format("metadata")}),
tr AS (SELECT asset_id, replace(x.fullkey, '"', '') p, x.type ty, CASE x.type WHEN 'VARCHAR' THEN {_PLAIN.format("x.atom ->> '$'")} WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN CAST(x.atom AS VARCHAR) ELSE CAST(CAST(CAST(x.atom AS VARCHAR) AS DOUBLE) AS VARCHAR) END a FROM vd, json_tree(j) x),
ps AS (SELECT asset_id, lower(p) p, a, CASE ty WHEN 'OBJECT' THEN 'o' WHEN 'ARRAY' THEN 'a' WHEN 'VARCHAR' THEN 's' WHEN 'NULL' THEN 'n' WHEN 'BOOLEAN' THEN 'b' ELSE 'd' END ty, regexp_extract(lower(p), '^(.*?\\.attributes\\[[0-9]+\\])', 1) el FROM tr),
es AS (SELECT asset_id, regexp_replace(el, '[0-9]+\\]$', '') base, list_sort(list(concat_ws(chr(1), substring(p, length(el) + 1), ty, a))) sg FROM ps WHERE el <> '' GROUP BY asset_id, el),
eg AS (SELECT asset_id, list_sort(list((base, sg))) es FROM es GROUP BY asset_id),
og AS (SELECT asset_id, list_sort(list(concat_ws(chr(1), p, ty, a))) os FROM ps WHERE el = '' GROUP BY asset_id),
sg AS (SELECT og.asset_id, os, es FROM og LEFT JOIN eg USING (asset_id))"""

ORACLES |= {
    "relation_shares": f"""WITH {_RELATIONS}, {_CLEAN}, {_TOTALS}, s AS (SELECT *, unnest(CASE WHEN seed_chain = candidate_chain THEN [{{'scope': 'all', 'p': NULL, 's': NULL}}, {{'scope': 'intra', 'p': NULL, 's': NULL}}, {{'scope': 'intra_chain', 'p': seed_chain, 's': NULL}}]
        ELSE [{{'scope': 'all', 'p': NULL, 's': NULL}}, {{'scope': 'cross', 'p': NULL, 's': NULL}}, {{'scope': 'cross_primary', 'p': seed_chain, 's': NULL}}, {{'scope': 'matrix', 'p': seed_chain, 's': candidate_chain}}] END) x FROM uni),
        rc AS (SELECT x.scope scope, x.p primary_chain, x.s secondary_chain, count(DISTINCT (seed_chain, seed_address)) seeds, count(DISTINCT (candidate_chain, candidate_address)) candidates, count(*) relations FROM s GROUP BY ALL),
        w AS (SELECT rc.*, CASE WHEN scope = 'matrix' THEN secondary_chain WHEN scope = 'intra_chain' THEN primary_chain END o FROM rc), v AS (SELECT w.*, CAST(CASE WHEN o IS NULL THEN (SELECT sum(contracts) FROM t) ELSE t.contracts END AS BIGINT) n FROM w LEFT JOIN t ON t.chain = o)
        SELECT scope, primary_chain, secondary_chain, seeds, candidates, relations, n contracts, round(candidates / n, 9) candidate_share FROM v""",
    "asset_facts": f"""WITH x AS (SELECT asset_id, chain, trim(contract_address) a, {_STRIP.format("coalesce(asset_name, '')")} n, metadata FROM nft_assets)
        SELECT asset_id, CASE WHEN lower(trim(chain)) = 'solana' THEN coalesce(regexp_full_match(a, '[1-9A-HJ-NP-Za-km-z]+') AND ((length(a) = 44 AND a <= '{_base58(2**256 - 1)}') OR (length(a) = 43 AND a >= '{_base58(2**248)}')), false) ELSE regexp_full_match(a, '0[xX][0-9a-fA-F]{{40}}') END valid_address,
        n <> '' AND lower(n) NOT IN ({", ".join(f"'{x}'" for x in text.NO_NAME)}) AND NOT regexp_full_match(n, '[0-9]') usable_name,
        CASE WHEN json_valid(metadata) THEN coalesce({", ".join(f"nullif(trim(metadata ->> '$.{k}'), '')" for k in text.IMAGE_KEYS)}) END image FROM x""",
    "exported_snapshot": f"""WITH {_name_norm()} SELECT lower(trim(chain)) chain, coalesce({_address("chain", "contract_address")}, '') contract_address, coalesce(token_id, '') token_id, coalesce(token_uri, '') token_uri, coalesce(image_uri, '') image_uri, coalesce(asset_name, '') AS name, coalesce(symbol, '') symbol,
        coalesce(metadata, '') metadata_json, {_url("token_uri")} token_uri_norm, {_url("image_uri")} image_uri_norm, coalesce(lower(regexp_replace(n, '\\s+', ' ', 'g')), '') name_norm FROM nft_assets JOIN n4 USING (asset_id)""",
    "snapshot_anchors": f"""WITH v AS (SELECT row_id, lower(trim(chain)) chain, {_address("chain", "contract_address")} contract_address, trim(token_id) token_id FROM snapshot WHERE trim(chain) <> '' AND trim(contract_address) <> '' AND trim(token_id) <> '' AND {_VALID.format("metadata_json")})
        SELECT chain, contract_address, token_id, min(row_id) row_id FROM v GROUP BY ALL""",
    "canonical_documents": f"WITH {_CANON} SELECT min(asset_id) asset_id, count(*) copies FROM sg GROUP BY os, es",
    "related_name_hits": f"WITH h AS ({ORACLES['seed_name_hits']}), r AS (SELECT DISTINCT candidate_chain, candidate_address FROM (WITH {_RELATIONS} SELECT * FROM uni)) SELECT h.* FROM h SEMI JOIN r USING (candidate_chain, candidate_address)",
}

#: documents as texts where these are valid, which canonical forms of them have the same words as, in the test tables
_FIRST_VALID = _FIRST_TEXTS.replace("AND trim(metadata_json) <> ''", "AND " + _VALID.format("metadata_json"))
_VALID_PAIRS = f"{_FIRST_VALID}, {_text_match(_CONTRACTS)}, vp AS (SELECT x.chain chain_a, x.contract_address contract_a, y.chain chain_b, y.contract_address contract_b, s score FROM mt JOIN us x ON x.u = a JOIN us y ON y.u = b)"
ORACLES |= {
    "metadata_pairs": f"WITH {_CLEAN}, {_VALID_PAIRS} SELECT * REPLACE (round(score, 9) AS score) FROM vp",
    "metadata_scopes": f"WITH {_CLEAN}, {_FIRST_VALID}, {_text_match(_UNITS)}, {_TEXT_SCOPES.format('mt', 'mt')} {_COUNTED.format('metadata')}",
    "sampled_metadata_pairs": f"""WITH {_CLEAN}, {_VALID_PAIRS}, pi AS (SELECT DISTINCT chain, contract_address FROM k WHERE image_uri_norm <> ''),
        pb AS (SELECT chain_a = chain_b same FROM vp SEMI JOIN pi x ON x.chain = chain_a AND x.contract_address = contract_a SEMI JOIN pi y ON y.chain = chain_b AND y.contract_address = contract_b)
        SELECT CASE WHEN same THEN 'intra' ELSE 'cross' END pool, least(3, count(*)) pairs FROM pb GROUP BY 1""",
}
