"""Tokens that share a URI: exact groups, never pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.operators.scopes import edge_scope, scope_counts
from twinledger.operators.skew import hot_keys, spread_join
from twinledger.runtime import land


def postings(tokens: DataFrame, uri: str) -> DataFrame:
    """(uri, chain, contract_address, n) of non-empty URIs: the first aggregation, which makes a URI of millions of tokens few rows."""
    return tokens.filter(F.col(uri) != "").groupBy(F.col(uri).alias("uri"), "chain", "contract_address").agg(F.count(F.lit(1)).alias("n"))


def uri_scopes(posted: DataFrame) -> DataFrame:
    """(uri, chain, own, peers): per URI and chain whether two contracts of the chain share it, and the other chains that have it, sorted.

    URIs that only one contract has are left out. The array is as long as there are chains.
    """
    per_chain = posted.groupBy("uri", "chain").agg(F.count(F.lit(1)).alias("contracts"))
    all_chains = per_chain.groupBy("uri").agg(F.sort_array(F.collect_set("chain")).alias("chains"), F.sum("contracts").alias("total")).filter("total > 1")
    both = per_chain.join(all_chains, "uri")
    return both.select("uri", "chain", (F.col("contracts") > 1).alias("own"), F.array_remove("chains", F.col("chain")).alias("peers"))


def _hits(posted: DataFrame, intra, peers) -> DataFrame:
    """The scopes that postings with (intra, peers) count in."""
    def scope(kind, peer):
        return F.struct(F.lit(kind).alias("kind"), peer.cast("string").alias("secondary_chain"))

    none = F.lit(None)
    found = F.concat(
        F.when(intra, F.array(scope("intra", none))).otherwise(F.array()),
        F.when(F.size(peers) > 0, F.array(scope("cross", none))).otherwise(F.array()),
        F.transform(peers, lambda p: scope("matrix", p)),
    )
    return posted.withColumn("__s", F.explode(found)).select("__s.kind", F.col("chain").alias("primary_chain"), "__s.secondary_chain", "contract_address", "n")


def token_uri_counts(tokens: DataFrame) -> DataFrame:
    """Scope counts of shared token URIs: intra if two contracts of a chain share one, cross and matrix if several chains do."""
    posted = postings(tokens, "token_uri_norm")
    flagged = posted.join(uri_scopes(posted), ["uri", "chain"])
    return scope_counts(_hits(flagged, F.col("own"), F.col("peers")), "token_uri")


def image_uri_counts(tokens: DataFrame) -> DataFrame:
    """Scope counts of shared image URIs, over the tokens that their token URI did not count in the same scope already.

    intra: tokens whose token URI is no intra hit, in two contracts at least. cross: tokens whose token URI is no cross hit, on two
    chains at least. matrix(k, s): tokens of k whose token URI is not on s, and such tokens the other way, both at least one.
    """
    scopes = uri_scopes(postings(tokens, "token_uri_norm")).select(F.col("uri").alias("token_uri_norm"), "chain", F.col("own").alias("t_own"), F.col("peers").alias("t_peers"))
    pictured = tokens.filter("image_uri_norm <> ''").select("chain", "contract_address", "token_uri_norm", "image_uri_norm")
    # tokens of one image, contract and token URI behave alike, so they move as one row
    alike = pictured.groupBy(F.col("image_uri_norm").alias("uri"), "chain", "contract_address", "token_uri_norm").agg(F.count(F.lit(1)).alias("n"))
    marked = alike.join(scopes, ["token_uri_norm", "chain"], "left").select("uri", "chain", "contract_address", "n", F.coalesce("t_own", F.lit(False)).alias("t_own"), F.coalesce("t_peers", F.array().cast("array<string>")).alias("t_peers"))
    null = F.lit(None).cast("string")

    inner = marked.filter(~F.col("t_own")).groupBy("uri", "chain", "contract_address").agg(F.sum("n").alias("n"))
    several = inner.groupBy("uri", "chain").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    intra = inner.join(several, ["uri", "chain"], "left_semi").select(F.lit("intra").alias("kind"), F.col("chain").alias("primary_chain"), null.alias("secondary_chain"), "contract_address", "n")

    outer = marked.filter(F.size("t_peers") == 0).groupBy("uri", "chain", "contract_address").agg(F.sum("n").alias("n"))
    wide = outer.groupBy("uri").agg(F.min("chain").alias("lo"), F.max("chain").alias("hi")).filter("lo <> hi").select("uri")
    cross = outer.join(wide, "uri", "left_semi").select(F.lit("cross").alias("kind"), F.col("chain").alias("primary_chain"), null.alias("secondary_chain"), "contract_address", "n")

    chains = marked.groupBy("uri").agg(F.collect_set("chain").alias("chains")).filter(F.size("chains") > 1)
    open_to = marked.join(chains, "uri").withColumn("peer", F.explode(F.array_except(F.array_remove("chains", F.col("chain")), F.col("t_peers"))))
    sided = open_to.groupBy("uri", "chain", "peer", "contract_address").agg(F.sum("n").alias("n"))
    sides = sided.select("uri", F.col("peer").alias("chain"), F.col("chain").alias("peer")).distinct()
    matrix = sided.join(sides, ["uri", "chain", "peer"], "left_semi").select(F.lit("matrix").alias("kind"), F.col("chain").alias("primary_chain"), F.col("peer").alias("secondary_chain"), "contract_address", "n")
    return scope_counts(intra.unionByName(cross).unionByName(matrix), "image_uri")


def alike(tokens: DataFrame) -> DataFrame:
    """(chain, contract_address, token_uri_norm, image_uri_norm, n): tokens of a contract with the same two URIs as one row."""
    return tokens.groupBy("chain", "contract_address", "token_uri_norm", "image_uri_norm").agg(F.count(F.lit(1)).alias("n"))


def seed_uri_edges(tokens: DataFrame, seeds: DataFrame, uri: str, dimension: str) -> DataFrame:
    """(seed_chain, seed_address, candidate_chain, candidate_address, token_id, dimension): tokens of other contracts that share a URI with a seed.

    Seeds (chain, contract_address) are reduced to distinct (seed, uri) first.
    """
    key = seeds.select("chain", "contract_address").distinct()
    given = tokens.filter(F.col(uri) != "").select("chain", "contract_address", "token_id", F.col(uri).alias("uri"))
    wanted = given.join(key, ["chain", "contract_address"], "left_semi").select(F.col("chain").alias("seed_chain"), F.col("contract_address").alias("seed_address"), "uri").distinct()
    probed = given.select(F.col("chain").alias("candidate_chain"), F.col("contract_address").alias("candidate_address"), "token_id", "uri")
    joined = probed.join(wanted, "uri").filter((F.col("seed_chain") != F.col("candidate_chain")) | (F.col("seed_address") != F.col("candidate_address")))
    return joined.select("seed_chain", "seed_address", "candidate_chain", "candidate_address", "token_id", F.lit(dimension).alias("dimension"))


def uri_profiles(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): contracts with the same shared URIs as one profile.

    A URI is shared if two contracts have it. members: (chain, contract_address, profile, t, i, n), the tokens of a contract by the shared URIs that
    they have, empty if none, those with none left out. classes: (profile, chain, t, i, contracts, n) summed over the contracts of a profile, which
    all have these pairs of URIs and lie on one chain. A profile is known by its chain and 128 bits of its pairs, summed up in any order, so no contract's list is collected.
    """
    own = land(alike(tokens.filter("token_uri_norm <> '' or image_uri_norm <> ''")), "alike")

    def shared(uri: str, name: str) -> DataFrame:
        each = own.filter(F.col(uri) != "").select("chain", "contract_address", uri).distinct()
        return each.groupBy(uri).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(uri, F.col(uri).alias(name))

    kept = own
    for uri, name in (("token_uri_norm", "t"), ("image_uri_norm", "i")):
        known = land(shared(uri, name), "shared")
        kept = spread_join(kept, known, [uri], hot_keys(own, [uri]), ["chain", "contract_address"], "left")
    none = F.lit("")
    pairs = kept.select("chain", "contract_address", F.coalesce("t", none).alias("t"), F.coalesce("i", none).alias("i"), "n").filter("t <> '' or i <> ''")
    pairs = land(pairs.groupBy("chain", "contract_address", "t", "i").agg(F.sum("n").alias("n")), "pairs")
    bits = [F.bit_xor(F.xxhash64(F.lit(seed), "t", "i")) for seed in ("one", "two")]
    named = pairs.groupBy("chain", "contract_address").agg(*(b.alias(f"h{k}") for k, b in enumerate(bits)), F.count(F.lit(1)).alias("k"))
    named = named.select("chain", "contract_address", F.concat_ws("-", "chain", F.hex("h0"), F.hex("h1"), F.col("k").cast("string")).alias("profile"))
    members = land(pairs.join(named, ["chain", "contract_address"]), "profile-members")
    return members, land(members.groupBy("profile", "chain", "t", "i").agg(F.count(F.lit(1)).alias("contracts"), F.sum("n").alias("n")), "profile-classes")


def seed_uri_scale(tokens: DataFrame, seeds: DataFrame, images_apart: bool = False, by_scope: bool = False, profiles: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(seed_chain, seed_address, dimension, candidate_contracts, candidate_nfts): what seed_scale gives of the token and image edges of seeds.

    No edge is made: contracts with the same shared URIs are one profile (see uri_profiles), the profiles of seeds meet those of others, and a
    seed's own contract is taken off what its profile reaches; so a URI that very many contracts have costs as many pairs as it has profiles.
    images_apart: image edges count only for tokens that no token URI edge of the same seed has already. by_scope: one row for each scope that the
    candidates lie in (see scopes.edge_scope), with scope and secondary_chain. profiles: those of the tokens, see uri_profiles.
    """
    members, classes = uri_profiles(tokens) if profiles is None else profiles
    numbered = land(classes.withColumn("class", F.monotonically_increasing_id()), "numbered")
    mine = members.join(seeds.select("chain", "contract_address").distinct(), ["chain", "contract_address"], "left_semi")
    probing = land(numbered.join(mine.select("profile").distinct(), "profile", "left_semi").select(F.col("profile").alias("seed_profile"), F.col("chain").alias("seed_chain"), "t", "i"), "probing")

    def met(uri: str, bit: int) -> DataFrame:
        wanted = land(probing.filter(F.col(uri) != "").select("seed_profile", "seed_chain", uri).distinct(), "wanted")
        given = numbered.filter(F.col(uri) != "").select("profile", "chain", "class", "contracts", "n", uri)
        found = spread_join(given, wanted, [uri], hot_keys(given, [uri], least=1_000), ["class"])
        return found.select("seed_profile", "seed_chain", "profile", "chain", "class", "contracts", "n", F.lit(bit).alias("bits"))

    key = ["seed_profile", "seed_chain", "profile", "chain"]
    each = met("t", 1).unionByName(met("i", 2)).groupBy(*key, "class", "contracts", "n").agg(F.bit_or("bits").alias("bits"))

    def sums(bits, contracts, tokens_):
        image = (bits == 2) if images_apart else (bits >= 2)
        kinds = {"token_uri": bits % 2 == 1, "image_uri": image, "total": F.lit(True)}
        return [x for k, c in kinds.items() for x in (F.max(F.when(c, contracts)).alias(f"{k}_c"), F.sum(F.when(c, tokens_)).alias(f"{k}_n"))]

    # all contracts of a profile have the same pairs of URIs, so each pair has as many contracts as its profile
    pairs = each.groupBy(*key).agg(*sums(F.col("bits"), F.col("contracts"), F.col("n")))
    scope = edge_scope("seed_chain", "chain") if by_scope else F.array(F.struct(F.lit("total").alias("scope"), F.lit(None).cast("string").alias("secondary_chain")))
    scoped = pairs.withColumn("s", F.explode(scope)).select("*", "s.*").groupBy("seed_profile", "scope", "secondary_chain")
    kinds = ("token_uri", "image_uri", "total")
    reached = scoped.agg(*(F.sum(f"{k}_{x}").alias(f"{k}_{x}") for k in kinds for x in "cn"))
    # what a seed's own contract has of this, in the scopes that its own chain lies in
    bits = F.when(F.col("t") != "", 1).otherwise(0) + F.when(F.col("i") != "", 2).otherwise(0)
    own = mine.withColumn("bits", bits).groupBy("chain", "contract_address", "profile").agg(*(c.alias(f"own_{k}_{x}") for (k, x), c in zip(((k, x) for k in kinds for x in "cn"), sums(F.col("bits"), F.lit(1), F.col("n")))))
    joined = own.select(F.col("chain").alias("seed_chain"), F.col("contract_address").alias("seed_address"), F.col("profile").alias("seed_profile"), *(c for c in own.columns if c.startswith("own_"))).join(reached, "seed_profile")
    inside = F.col("scope").isin("total", "intra")
    left = lambda k, x: F.coalesce(f"{k}_{x}", F.lit(0)) - F.when(inside, F.coalesce(f"own_{k}_{x}", F.lit(0))).otherwise(0)
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), left(k, "c").cast("long").alias("candidate_contracts"), left(k, "n").cast("long").alias("candidate_nfts")) for k in kinds)))
    out = joined.withColumn("d", rows).select("seed_chain", "seed_address", *(("scope", "secondary_chain") if by_scope else ()), "d.*")
    return out.filter("candidate_contracts > 0")


def shared_tokens(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (seed_chain, seed_address, candidate_chain, candidate_address) those that share a URI, and the number n of the candidate's tokens that
    have one of the seed's. members: see uri_profiles."""
    seed, candidate = ["seed_chain", "seed_address"], ["candidate_chain", "candidate_address"]
    named = lambda key: (F.col("chain").alias(key[0]), F.col("contract_address").alias(key[1]))
    found = pairs.select(*seed, *candidate).join(members.select(*named(candidate), "t", "i", "n"), candidate)
    for uri in ("t", "i"):
        own = members.filter(F.col(uri) != "").select(*named(seed), uri).distinct().withColumn(f"has_{uri}", F.lit(True))
        found = found.join(own, [*seed, uri], "left")
    return found.filter("has_t or has_i").groupBy(*seed, *candidate).agg(F.sum("n").alias("n"))


def whole_scale(tokens: DataFrame, seeds: DataFrame, whole: DataFrame) -> DataFrame:
    """What seed_scale gives of the URI edges of seeds and of whole, (seed_chain, seed_address, candidate_chain, candidate_address, dimension), each of which
    stands for an edge to every token of its candidate.

    No edge to a token is made: URIs count by profiles (see seed_uri_scale), whole contracts by their sizes, and all together as the sum of both
    less what pairs of ``whole`` share in URIs.
    """
    seed, candidate = ["seed_chain", "seed_address"], ["candidate_chain", "candidate_address"]
    profiles = uri_profiles(tokens)
    by_uri = land(seed_uri_scale(tokens, seeds, profiles=profiles), "by-uri")
    sizes = tokens.groupBy(F.col("chain").alias(candidate[0]), F.col("contract_address").alias(candidate[1])).agg(F.count(F.lit(1)).alias("n"))
    sized = land(whole.groupBy(*seed, *candidate).agg(F.collect_set("dimension").alias("dimensions")).join(sizes, candidate), "whole")
    total = F.lit("total").alias("dimension")
    sums = (F.count(F.lit(1)).alias("candidate_contracts"), F.sum("n").alias("candidate_nfts"))
    by_whole = sized.withColumn("dimension", F.explode(F.concat("dimensions", F.array(total)))).groupBy(*seed, "dimension").agg(*sums)
    twice = shared_tokens(profiles[0], sized).groupBy(*seed, total).agg(*sums)
    less = twice.select(*seed, "dimension", *((-F.col(c)).alias(c) for c in ("candidate_contracts", "candidate_nfts")))
    every = by_uri.unionByName(by_whole).unionByName(less)
    return every.groupBy(*seed, "dimension").agg(*(F.sum(c).alias(c) for c in ("candidate_contracts", "candidate_nfts")))


def seed_scale(edges: DataFrame) -> DataFrame:
    """Per seed and dimension, and for all dimensions together (``total``, a union, not a sum): candidate contracts and tokens.

    Edges that repeat count once.
    """
    key = ["seed_chain", "seed_address"]
    what = ["candidate_chain", "candidate_address", "token_id"]
    both = edges.select(*key, *what, F.explode(F.array("dimension", F.lit("total"))).alias("dimension")).distinct()
    per_contract = both.groupBy(*key, "dimension", "candidate_chain", "candidate_address").agg(F.count("token_id").alias("tokens"))
    return per_contract.groupBy(*key, "dimension").agg(F.count(F.lit(1)).alias("candidate_contracts"), F.sum("tokens").alias("candidate_nfts"))


def image_minus_token(edges: DataFrame) -> DataFrame:
    """Edges without the image edges to tokens that a token URI edge of the same seed has already."""
    on = [c for c in edges.columns if c != "dimension"]
    covered = edges.filter("dimension = 'token_uri'").select(*on)
    images = edges.filter("dimension = 'image_uri'").join(covered, on, "left_anti")
    return edges.filter("dimension <> 'image_uri'").unionByName(images.select(*edges.columns))
