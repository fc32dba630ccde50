"""The plans are the ones wanted: what reaches the scan, and whole runs on the known small cases."""

import json

import pytest
from pyspark.sql import functions as F

from twinledger.plans import pipeline
from twinledger.sources import sinks
from twinledger.sources import snapshot as source

SNAP = "row_id long, chain string, contract_address string, token_id string, name_norm string, token_uri_norm string, image_uri_norm string, metadata_json string"


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    data = [
        ("ethereum", "0xseed", "1", "goldenseed", "ipfs://intra-shared", "", '{"name":"seed1"}'), ("ethereum", "0xseed", "2", "goldenseed", "ipfs://seed-only", "", '{"name":"seed2"}'),
        ("ethereum", "0xseed", "3", "goldenseed", "ipfs://cross-shared", "", '{"name":"seed3"}'), ("ethereum", "0xdup", "1", "dupcontract", "ipfs://intra-shared", "", '{"name":"dup1"}'),
        ("base", "0xbase", "1", "baseonly", "ipfs://cross-shared", "", '{"name":"base1"}'), ("solana", "collsol", "mint_a", "solonly", "ipfs://sol-only", "", '{"name":"sol1"}'),
    ]
    path = str(tmp_path_factory.mktemp("golden") / "snapshot.parquet")
    spark.createDataFrame([(i, *r) for i, r in enumerate(data)], SNAP).coalesce(1).write.parquet(path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_and_chains_are_read(spark, golden):
    df = source.read_snapshot(spark, golden, source.ReadOptions(chains=["base"], dimensions=["token_uri"], order="row_id"))
    scan = plan(source.tokens(df))
    assert "token_uri_norm" in scan and "metadata_json" not in scan and "image_uri_norm" not in scan


def test_exported_snapshot_prunes_chains(spark, tmp_path):
    df = spark.createDataFrame([("base", "1"), ("solana", "2")], "chain string, token_id string")
    sinks.write_snapshot(df, str(tmp_path / "s"))
    one = spark.read.parquet(str(tmp_path / "s")).filter("chain = 'base'")
    assert "PartitionFilters: [isnotnull(chain" in plan(one) and one.count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_snapshot(df, str(tmp_path / "s"))
    sinks.write_snapshot(df, str(tmp_path / "s"), force=True)


def test_whole_run(spark, golden, tmp_path):
    out = str(tmp_path / "reports")
    report = {(r.kind, r.primary_chain, r.secondary_chain, r.dimension): r for r in pipeline.run_all(spark, golden, out, name_threshold=0.98, order="row_id").collect()}
    intra = report["intra", "ethereum", None, "token_uri"]
    assert (intra.duplicate_contract_count, intra.duplicate_nft_count, intra.nft_ratio) == (2, 2, 0.5)
    assert report["matrix", "base", "ethereum", "token_uri"].duplicate_nft_count == 1 == report["cross", "ethereum", None, "token_uri"].duplicate_nft_count
    facts = json.loads(sinks.read_text(spark, f"{out}/manifest.json"))
    assert facts["totals"] == [{"chain": "base", "contracts": 1, "nfts": 1}, {"chain": "ethereum", "contracts": 2, "nfts": 4}, {"chain": "solana", "contracts": 1, "nfts": 1}]
    assert spark.read.csv(f"{out}/summary", header=True).count() == len([k for k in report if k[0] != "matrix"])


def test_seeds_against_a_snapshot(spark, golden):
    rows = source.read_snapshot(spark, golden, source.ReadOptions(order="row_id"))
    seeds = spark.createDataFrame([("ethereum", "0xseed")], "chain string, contract_address string")
    edges = pipeline.match_seeds(rows, seeds)
    assert sorted((r.candidate_address, r.token_id, r.dimension) for r in edges.collect()) == [("0xbase", "1", "token_uri"), ("0xdup", "1", "token_uri")]
    tokens = source.tokens(rows)
    whole = edges.limit(1).withColumn("token_id", F.lit(None).cast("string")).withColumn("candidate_chain", F.lit("ethereum")).withColumn("candidate_address", F.lit("0xseed"))
    assert pipeline.expand_edges(whole, tokens).count() == 3
    replaced = pipeline.overlay_seeds(tokens, tokens.filter("contract_address = '0xseed'").limit(1))
    assert replaced.filter("contract_address = '0xseed'").count() == 1 and replaced.count() == 4


def test_names_match_with_and_without_threshold(spark, tmp_path):
    data = [("base", "0xa", "1", "collection", "", "", ""), ("base", "0xb", "1", "collectiom", "", "", "")]
    path = str(tmp_path / "s.parquet")
    spark.createDataFrame([(i, *r) for i, r in enumerate(data)], SNAP).write.parquet(path)
    assert pipeline.run_name(spark, path, 0.95, order="row_id").count() == 1
    assert pipeline.run_name(spark, path, None, order="row_id").count() == 0
    with pytest.raises(ValueError):
        spark.createDataFrame([(9, "base", "0xa", "1", "", "ipfs:other", "", ""), (8, "base", "0xa", "1", "", "ipfs:one", "", "")], SNAP).write.mode("append").parquet(path)
        pipeline.run_uri(spark, path, order="row_id", strict=True)


def test_hit_queries_over_all_seeds_pass_no_ranking_limit(spark, tmp_path):
    from twinledger.plans import snapshot_queries as queries

    n = queries.SEEDS_PER_RANKING + 3
    spark.createDataFrame([(i, "base", f"0x{i}", "1", f"n{i}", "u", "", "{}") for i in range(n + 2)], SNAP).write.parquet(f"{tmp_path}/snapshot.parquet")
    seeds = [("base", f"0x{i}", i, "c", "m", "w", "f", None) for i in range(n)] + [(None, "0xz", 1, "c", "m", "w", "f", None), ("base", " ", 1, "c", "m", "w", "f", None)]
    spark.createDataFrame(seeds, "chain string, address string, seed_rank int, collection_name string, metric string, metric_window string, feed string, collected_at timestamp").write.parquet(f"{tmp_path}/seeds.parquet")
    assert [r.nfts for r in queries.unlisted_tokens(spark, str(tmp_path)).collect()] == [2]
    assert queries.seed_uri_scale(spark, str(tmp_path)).filter("dimension = 'token_uri'").select("seed_address").distinct().count() == n


def test_seeds_are_probed_without_joining_the_snapshot_with_itself(spark):
    """Names and documents of others meet those of seeds only, and metadata of rows that can't matter is not parsed."""
    from twinledger.operators import metadata_match, name_match

    doc = lambda i: '{"name":"n%d","w":"%s"}' % (i, " ".join(f"w{i}x{j}" for j in range(12)))
    data = [(i, "base", f"0x{i % 9}", str(i // 9), f"collection {chr(97 + i % 9)}", "", "", doc(i % 4)) for i in range(90)] + [(200 + i, "solana", "S", f"m{i}", "other", "", "", doc(i)) for i in range(3)]
    data += [(300, "base", "0x8", "99", "", "", "", "no json"), (301, "base", "0x7", "98", "", "", "", "{}"), (302, "base", "0x7", "50", "", "", "", doc(1))]
    rows = source.clean(source.validate(spark.createDataFrame(data, SNAP), source.ReadOptions(order="row_id")))
    rows = pipeline.land(rows, "rows")
    seeds = spark.createDataFrame([("base", "0x1"), ("base", "0x2")], "chain string, contract_address string")
    every = metadata_match.similar_contracts(source.anchors(rows), 0.6)
    mine = metadata_match.similar_contracts(source.seed_anchors(rows, seeds), 0.6, seeds)
    of_seeds = every.filter("contract_a in ('0x1', '0x2') or contract_b in ('0x1', '0x2')")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, of_seeds.collect())) and mine.count() < every.count()
    parsed = {(r.contract_address, r.token_id) for r in source.seed_anchors(rows, seeds).collect()}
    assert ("S", "m2") in parsed and ("S", "m1") not in parsed  # only its highest
    assert ("0x7", "50") in parsed and {r.contract_address for r in source.seed_anchors(rows, seeds).collect()} == {r.contract_address for r in rows.select("contract_address").collect()}
    members = name_match.name_members(source.tokens(rows))
    pairs = pipeline.seed_name_pairs(members, seeds, 0.9)
    assert {x for r in pairs.collect() for x in (r.a, r.b)} and all({"collection b", "collection c"} & {r.a, r.b} for r in pairs.collect())


def test_seeds_are_scaled_without_an_edge_for_each_token(spark, tmp_path):
    """What edges to tokens add up to, where hits by URI, name and metadata overlap; no table on the way grows as contracts times tokens."""
    import random

    from twinledger import runtime
    from twinledger.operators import uri_match
    from twinledger.plans import snapshot_queries as queries

    rng = random.Random(4)
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    at = lambda c: ("solana", f"S{c}") if c % 7 == 0 else ("base", f"0x{c}")
    crowd = [(*at(c), str(t), f"crowd {c * 7919:08b}", "hidden", f"i{c % 9}" if t == 1 else "", "") for c in range(60) for t in range(5)]
    mixed = [(*at(c), str(t), rng.choice(["golden harbour", "golden harbor", "other thing", ""]), rng.choice(["hidden", "u1", "u2", ""]), rng.choice(["p1", "p2", ""]), rng.choice([text(1), text(1) + " more", text(2), ""])) for c in range(100, 130) for t in range(3)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(crowd + mixed)], SNAP).write.parquet(f"{tmp_path}/snapshot.parquet")
    seeds = [(*at(c), 1, "c", "m", "w", "f", None) for c in (*range(0, 60, 2), *range(100, 130, 3), 999)]
    spark.createDataFrame(seeds, "chain string, address string, seed_rank int, collection_name string, metric string, metric_window string, feed string, collected_at timestamp").write.parquet(f"{tmp_path}/seeds.parquet")

    before = set(runtime._scopes[-1])
    found = sorted(map(tuple, queries.seed_hits(spark, str(tmp_path)).collect()))
    made = {p: spark.read.parquet(p).count() for p in runtime._scopes[-1] if p not in before}
    assert max(made.values()) <= 4 * len(crowd + mixed)
    rows = pipeline.land(source.read_snapshot(spark, f"{tmp_path}/snapshot.parquet", source.ReadOptions(order="row_id")), "rows")
    edges = pipeline.match_seeds(rows, source.seed_contracts(spark.read.parquet(f"{tmp_path}/seeds.parquet")), 0.95, 0.6, documents=lambda rows, _: source.first_texts(rows))
    truth = uri_match.seed_scale(pipeline.expand_edges(edges, source.tokens(rows)))
    assert found == sorted(map(tuple, truth.collect())) and {r[2] for r in found} == {"token_uri", "image_uri", "name", "metadata", "total"}


def test_names_of_several_blocks(spark, monkeypatch):
    """Blocks of names meet once each, whatever their lengths."""
    import itertools
    import random

    from twinledger.functions.similarity import jaro_winkler
    from twinledger.operators import name_match

    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randint(3, 60))) for _ in range(60)]
    names = sorted({*base, *(x[:k] + rng.choice("abz") + x[k + 1 :] for x in base for k in (0, len(x) // 2)), *(x + "s" for x in base)})
    monkeypatch.setattr(name_match, "PART", 16)
    pairs = name_match.name_pairs(spark.createDataFrame([(n,) for n in names], "name string"), 0.93)
    truth = {(a, b): s for a, b in itertools.combinations(names, 2) if (s := jaro_winkler(a, b)) >= 0.93}
    found = [(r.a, r.b, r.similarity) for r in pairs.collect()]
    assert {(a, b): s for a, b, s in found} == truth and len(found) == len(truth) > 100
