"""Whole runs: match a snapshot on the chosen dimensions, or seeds against it, and write the reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.operators import metadata_match, name_match, scopes, staging, uri_match
from twinledger.runtime import land
from twinledger.sources import sinks
from twinledger.sources import snapshot as source

REPORT_ORDER = ["primary_chain", "kind", "secondary_chain", "dimension"]


def match_uris(tokens: DataFrame) -> DataFrame:
    """Scope counts of token and image URIs."""
    return uri_match.token_uri_counts(tokens).unionByName(uri_match.image_uri_counts(tokens))


def match_names(tokens: DataFrame, threshold: float | None) -> DataFrame:
    """Scope counts of names; without a threshold only equal names match, at one of 0 or less all do."""
    members = land(name_match.name_members(tokens), "members")
    if threshold is not None and threshold <= 0:
        return scopes.all_match_counts(members, "name")
    pairs = None if threshold is None or threshold > 1 else land(name_match.name_pairs(land(members.select("name").distinct(), "names"), threshold), "pairs")
    return name_match.name_counts(members, pairs)


def match_metadata(rows: DataFrame, tokens: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Scope counts of contracts, and tokens on the chain with case-sensitive ids, with similar metadata."""
    return metadata_match.metadata_counts(source.anchors(rows), tokens, threshold)


def run_all(spark: SparkSession, paths: str | Iterable[str], out: str | None = None, dimensions: Sequence[str] = ("name", "uri", "metadata"), name_threshold: float | None = 0.98, metadata_threshold: float = 0.6, chains: Sequence[str] = (), order: str | None = None, strict: bool = False, force: bool = False) -> DataFrame:
    """Scope counts with their ratios over all chosen dimensions of a snapshot; with ``out`` also as CSV reports and a manifest there.

    strict: a token with several URIs in one column stops the run.
    """
    began = time.time()
    columns = [c for d in dimensions for c in {"name": ["name"], "uri": ["token_uri", "image_uri"], "metadata": ["metadata"]}[d]]
    rows = land(source.read_snapshot(spark, paths, source.ReadOptions(chains, columns, order)), "rows")
    if strict:
        source.refuse_conflicts(rows)
    tokens = land(source.tokens(rows), "tokens")
    found = {"name": lambda: match_names(tokens, name_threshold), "uri": lambda: match_uris(tokens), "metadata": lambda: match_metadata(rows, tokens, metadata_threshold)}
    counts = reduce(DataFrame.unionByName, (found[d]() for d in dimensions))
    totals = land(source.chain_totals(rows), "totals")
    report = land(scopes.with_ratios(counts, totals), "report")
    if out:
        tables = {"summary": report.filter("kind <> 'matrix'").orderBy(*REPORT_ORDER).coalesce(1), "chain_matrix": report.filter("kind = 'matrix'").orderBy(*REPORT_ORDER).coalesce(1)}
        tables |= {f"{d}_counts": report.filter(F.col("dimension").isin(*named)).orderBy(*REPORT_ORDER).coalesce(1) for d, named in {"name": ["name"], "uri": ["token_uri", "image_uri"], "metadata": ["metadata"]}.items() if d in dimensions}
        sinks.publish(tables, out, force, "csv", header="true")
        facts = {"inputs": [paths] if isinstance(paths, str) else list(paths), "dimensions": list(dimensions), "name_threshold": name_threshold, "metadata_threshold": metadata_threshold, "seconds": round(time.time() - began, 3), "totals": [r.asDict() for r in totals.orderBy("chain").collect()]}
        sinks.write_manifest(spark, f"{out}/manifest.json", facts)
    return report


def run_uri(spark: SparkSession, paths: str | Iterable[str], **options) -> DataFrame:
    return run_all(spark, paths, dimensions=("uri",), **options)


def run_name(spark: SparkSession, paths: str | Iterable[str], threshold: float | None = 0.98, **options) -> DataFrame:
    return run_all(spark, paths, dimensions=("name",), name_threshold=threshold, **options)


def run_metadata(spark: SparkSession, paths: str | Iterable[str], threshold: float = 0.6, **options) -> DataFrame:
    return run_all(spark, paths, dimensions=("metadata",), metadata_threshold=threshold, **options)


def select_seeds(seeds: DataFrame, per_ranking: int) -> DataFrame:
    """(chain, contract_address) of the best-ranked seeds."""
    return staging.top_seeds(seeds, per_ranking).select("chain", F.col("address").alias("contract_address")).distinct()


def overlay_seeds(tokens: DataFrame, seed_tokens: DataFrame) -> DataFrame:
    """Tokens with those of the seeds' contracts replaced by what a provider lists for them."""
    key = ["chain", "contract_address"]
    return tokens.join(seed_tokens.select(*key).distinct(), key, "left_anti").unionByName(seed_tokens.select(*tokens.columns))


def seed_name_pairs(members: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """Similar names (see name_match.name_pairs) of which one at least is a seed's."""
    own = members.join(seeds.select("chain", "contract_address").distinct(), ["chain", "contract_address"], "left_semi").select("name").distinct()
    return name_match.name_pairs(land(members.select("name").distinct(), "names"), threshold, land(own, "seed-names"))


def match_seeds(rows: DataFrame, seeds: DataFrame, name_threshold: float | None = 0.98, metadata_threshold: float | None = 0.6, documents: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Hit edges (seed_chain, seed_address, candidate_chain, candidate_address, token_id, dimension, score) of seeds in cleaned rows.

    token_id is null where the whole contract is hit, as by names and metadata; URI hits name each token and score 1. Each dimension is
    probed with what the seeds have: names and documents of others are compared with those of seeds only, and metadata is parsed only
    where it can matter to a seed (see snapshot.seed_anchors). documents: makes the anchors of rows and seeds in another way.
    """
    rows, seeds = land(rows, "rows"), land(seeds.select("chain", "contract_address").distinct(), "seeds")
    tokens = land(source.tokens(rows), "tokens")
    edges = [uri_match.seed_uri_edges(tokens, seeds, f"{d}_norm", d).withColumn("score", F.lit(1.0)) for d in ("token_uri", "image_uri")]
    whole = lambda df, d: df.withColumn("token_id", F.lit(None).cast("string")).withColumn("dimension", F.lit(d))
    if name_threshold is not None:
        members = land(name_match.name_members(tokens), "members")
        edges.append(whole(name_match.seed_name_edges(members, seeds, seed_name_pairs(members, seeds, name_threshold)), "name"))
    if metadata_threshold is not None:
        anchors = documents(rows, seeds) if documents else source.seed_anchors(rows, seeds, normalised=False)
        pairs = metadata_match.both_ways(metadata_match.similar_contracts(anchors, metadata_threshold, seeds))
        mine = pairs.join(seeds, ["chain", "contract_address"], "left_semi")
        edges.append(whole(mine.select(F.col("chain").alias("seed_chain"), F.col("contract_address").alias("seed_address"), F.col("peer_chain").alias("candidate_chain"), F.col("peer_address").alias("candidate_address"), "score"), "metadata"))
    columns = ["seed_chain", "seed_address", "candidate_chain", "candidate_address", "token_id", "dimension", "score"]
    return reduce(DataFrame.unionByName, (e.select(*columns) for e in edges))


def expand_edges(edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """Edges with a token each: one that hits a whole contract stands for all its tokens."""
    own = tokens.select(F.col("chain").alias("candidate_chain"), F.col("contract_address").alias("candidate_address"), F.col("token_id").alias("__t"))
    whole = edges.filter("token_id is null").join(own, ["candidate_chain", "candidate_address"]).withColumn("token_id", F.col("__t")).select(*edges.columns)
    return edges.filter("token_id is not null").unionByName(whole)


def scale_seeds(tokens: DataFrame, texts: DataFrame, seeds: DataFrame, name_threshold: float, metadata_threshold: float) -> DataFrame:
    """What uri_match.seed_scale gives of all edges of seeds (see match_seeds and expand_edges), without making those to tokens.

    tokens: see snapshot.tokens. texts: a scan of cleaned rows with metadata, which is compared as texts.
    """
    seeds = land(seeds.select("chain", "contract_address").distinct(), "seeds")
    members = land(name_match.name_members(tokens), "members")
    key = ["seed_chain", "seed_address", "candidate_chain", "candidate_address"]
    names = name_match.seed_name_edges(members, seeds, land(seed_name_pairs(members, seeds, name_threshold), "name-pairs")).select(*key, F.lit("name").alias("dimension"))
    first, documents = source.keyed_texts(texts, metadata_match.doc_key)
    pairs = metadata_match.both_ways(land(metadata_match.similar_contracts(first, metadata_threshold, seeds, documents), "metadata-pairs"))
    mine = pairs.join(seeds, ["chain", "contract_address"], "left_semi").select("chain", "contract_address", "peer_chain", "peer_address").toDF(*key)
    return uri_match.whole_scale(tokens, seeds, names.unionByName(mine.withColumn("dimension", F.lit("metadata"))))


def restricted(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges to some candidates (chain, contract_address) only."""
    wanted = candidates.select(F.col("chain").alias("candidate_chain"), F.col("contract_address").alias("candidate_address")).distinct()
    return edges.join(wanted, ["candidate_chain", "candidate_address"], "left_semi").select(*edges.columns)


def run_seeds(spark: SparkSession, paths: str | Iterable[str], seeds: DataFrame, out: str | None = None, cache: str | None = None, per_ranking: int | None = None, candidates: DataFrame | None = None, name_threshold: float | None = 0.98, metadata_threshold: float | None = 0.6, order: str | None = None) -> DataFrame:
    """Seeds matched against a snapshot, scaled and reported: (seed_chain, seed_address, dimension, candidate_contracts, candidate_nfts).

    seeds: a table of rankings; the best per_ranking of each, or all that have a contract. cache: a folder that keeps the hit edges as long as
    the input files, seeds and thresholds stay the same (see sinks.fingerprint). candidates: only edges to these. With ``out`` the scale and the
    strongest relations are written as a tree of reports.
    """
    given = source.seed_contracts(seeds) if per_ranking is None else select_seeds(seeds, per_ranking)
    given = land(given, "given-seeds")
    rows = source.read_snapshot(spark, paths, source.ReadOptions(order=order))
    files = [paths] if isinstance(paths, str) else list(paths)

    def edges() -> DataFrame:
        return match_seeds(rows, given, name_threshold, metadata_threshold)

    if cache:
        known = given.agg(F.coalesce(F.bit_xor(F.xxhash64("chain", "contract_address")), F.lit(0)), F.count(F.lit(1))).first()
        found = sinks.cached(spark, cache, sinks.fingerprint(spark, files, seeds=list(known), name=name_threshold, metadata=metadata_threshold, order=order), edges)
    else:
        found = land(edges(), "edges")
    if candidates is not None:
        found = restricted(found, candidates)
    scale = land(uri_match.seed_scale(expand_edges(found, source.tokens(rows))), "scale")
    if out:
        per_dimension = scale.groupBy("dimension").agg(F.count(F.lit(1)).alias("seeds"), F.sum("candidate_contracts").alias("candidate_contracts"), F.sum("candidate_nfts").alias("candidate_nfts")).orderBy("dimension")
        strongest = scale.filter("dimension = 'total'").orderBy(F.col("candidate_nfts").desc(), "seed_chain", "seed_address").limit(100)
        sinks.write_tree(spark, out, {"summary": {"dimensions": per_dimension}, "detail": {"strongest_seeds": strongest}})
    return scale
