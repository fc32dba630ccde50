import itertools
import random

import pytest
from pyspark.sql import functions as F

from twinledger.functions.similarity import bm25_cosine, jaro_winkler
from twinledger.operators import eager, events, graph, metadata_match, name_match, ranking, representative, sampling, scopes, shred, staging, uri_match
from twinledger.sources import sinks
from twinledger.sources import snapshot as source

SNAP = "row_id long, chain string, contract_address string, token_id string, name_norm string, token_uri_norm string, image_uri_norm string, metadata_json string"


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def snap(spark, data):
    """(chain, contract, token, name, token uri, image uri, metadata) rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], SNAP)
    return source.clean(source.validate(df, source.ReadOptions(order="row_id")))


def counts(df):
    return {(r.kind, r.primary_chain, r.secondary_chain): (r.duplicate_contract_count, r.duplicate_nft_count) for r in df.collect()}


def test_clean_and_tokens(spark):
    df = snap(spark, [(" Ethereum", "0xA ", "1", "  ", "", None, None), ("ethereum", "0xa", "1", "n", "u", "i", " {} "), ("solana", "Ab", "x", None, "v", "", ""), ("base", " ", "1", "", "", "", ""), (None, "0xb", "1", "", "", "", ""), ("base", "0xb", None, "", "", "", "")])
    assert rows(source.tokens(df).drop("source_order")) == [("ethereum", "0xa", "1", "n", "u", "i"), ("solana", "Ab", "x", "", "v", "")]
    assert rows(source.chain_totals(df)) == [("ethereum", 1, 1), ("solana", 1, 1)]
    assert source.uri_conflicts(df).count() == 0
    with pytest.raises(ValueError):
        source.refuse_conflicts(snap(spark, [("a", "0x1", "1", "", "ipfs://one", "", ""), ("a", "0x1", "1", "", "ipfs://two", "", "")]))
    with pytest.raises(ValueError):
        source.validate(df.drop("token_id"))
    assert source.tokens(snap(spark, [])).count() == 0


def test_read_snapshot_in_file_order(spark, tmp_path):
    df = spark.createDataFrame([(2, "a", "0x1", "1", "later", "", "", ""), (1, "A ", "0x1", "1", "first", "", "", "{\"a\":1}")], SNAP).coalesce(1)
    df.write.parquet(str(tmp_path / "s"))
    by_file = source.tokens(source.read_snapshot(spark, str(tmp_path / "s"), source.ReadOptions(dimensions=["name"])))
    assert rows(by_file, "name_norm") == [("later",)]
    assert rows(source.tokens(source.read_snapshot(spark, str(tmp_path / "s"), source.ReadOptions(chains=["a"], order="row_id"))), "name_norm") == [("first",)]


def test_anchors(spark):
    df = snap(spark, [("a", "0x1", t, "", "", "", m) for t, m in [("2", "bad"), ("2", '{"a":1}'), ("2", '{"a":2}'), ("10", '{"b":1}'), ("1", "{}"), ("3", "")]])
    assert rows(source.anchors(df), "token_id", "document") == [("10", '{"b":1}'), ("2", '{"a":1}')]
    assert rows(source.anchors(df, keep=1), "token_id") == [("2",)] and rows(source.anchors(df, keep=1, highest=True), "token_id") == [("10",)]


def test_token_uri_counts(spark):
    shared = [("ethereum", "0xa", "1"), ("ethereum", "0xb", "1"), ("base", "0xc", "1")]
    tokens = source.tokens(snap(spark, [(*k, "", "u", "", "") for k in shared] + [("ethereum", "0xd", str(i), "", "own", "", "") for i in range(3)]))
    assert counts(uri_match.token_uri_counts(tokens)) == {("intra", "ethereum", None): (2, 2), ("cross", "ethereum", None): (2, 2), ("cross", "base", None): (1, 1), ("matrix", "ethereum", "base"): (2, 2), ("matrix", "base", "ethereum"): (1, 1)}
    assert uri_match.token_uri_counts(tokens.limit(0)).count() == 0


def test_image_uri_counts_only_what_token_uris_leave(spark):
    tokens = source.tokens(snap(spark, [("ethereum", "0xa", "1", "", "t", "i", ""), ("ethereum", "0xb", "1", "", "t", "other", ""), ("base", "0xc", "1", "", "else", "i", "")]))
    found = counts(uri_match.image_uri_counts(tokens))
    assert ("intra", "ethereum", None) not in found
    assert found[("matrix", "ethereum", "base")] == (1, 1) == found[("matrix", "base", "ethereum")]


def test_ratios_on_zero(spark):
    c = spark.createDataFrame([("intra", "x", None, "d", 1, 1)], "kind string, primary_chain string, secondary_chain string, dimension string, duplicate_contract_count long, duplicate_nft_count long")
    empty = spark.createDataFrame([], "chain string, contracts long, nfts long")
    assert rows(scopes.with_ratios(c, empty), "nft_ratio") == [(0.0,)] and rows(scopes.with_ratios(c, empty, None), "nft_ratio") == [(None,)]


def test_names(spark):
    data = [("ethereum", "0xa", str(i), n, "", "", "") for i, n in enumerate(["none", "7", "winner", "winner", "loser"])] + [("ethereum", "0xb", "1", "winner", "", "", ""), ("solana", "S", "x", "winner", "", "", ""), ("solana", "S", "y", "alone", "", "", "")]
    members = name_match.name_members(source.tokens(snap(spark, data)))
    assert rows(members, "name", "chain", "contract_address", "n") == [("alone", "solana", "S", 1), ("winner", "ethereum", "0xa", 5), ("winner", "ethereum", "0xb", 1), ("winner", "solana", "S", 1)]
    found = counts(name_match.name_counts(members))
    assert found[("intra", "ethereum", None)] == (2, 6) and found[("matrix", "solana", "ethereum")] == (1, 1)
    near = spark.createDataFrame([("ethereum", "0xa", "collection", 1, 4), ("ethereum", "0xb", "collectiom", 1, 3)], "chain string, contract_address string, name string, members long, n long")
    pairs = name_match.name_pairs(near.select("name"), 0.95)
    assert rows(pairs, "a", "b") == [("collectiom", "collection")]
    assert counts(name_match.name_counts(near, pairs)) == {("intra", "ethereum", None): (2, 7)}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 0.95, 1.0, 1.1])
def test_name_pairs_beside_brute_force(spark, threshold):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abé ") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    truth = {(a, b) for a, b in itertools.combinations(names, 2) if jaro_winkler(a, b) >= threshold}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("",)], "name string")
    assert set(rows(name_match.name_pairs(df, threshold), "a", "b")) == truth
    some = set(names[::7])
    probe = df.filter(F.col("name").isin(*some))
    assert set(rows(name_match.name_pairs(df, threshold, probe), "a", "b")) == {p for p in truth if some & set(p)}


def test_every_name_matches_at_no_threshold(spark):
    members = spark.createDataFrame([("ethereum", "0xa", "x", 1, 4), ("ethereum", "0xb", "y", 1, 3), ("base", "0xc", "z", 1, 2), ("solana", "S", "q", 3, 3)], "chain string, contract_address string, name string, members long, n long")
    every = spark.createDataFrame([(a, b) for a, b in itertools.combinations("qxyz", 2)], "a string, b string")
    assert counts(scopes.all_match_counts(members, "name")) == counts(name_match.name_counts(members, every))
    with pytest.raises(ValueError):
        name_match.name_pairs(members.select("name"), 0)


def test_jaro_winkler_of_many(spark):
    from twinledger.functions.similarity import jaro_winkler_many

    rng = random.Random(6)
    a = ["".join(rng.choice("abé\U0001F600 ") for _ in range(rng.randint(0, rng.choice([3, 12, 40, 200])))) for _ in range(400)] + ["", "", "a"]
    b = [x[: rng.randint(0, len(x))] + rng.choice(["", "b", "zz"]) + x[rng.randint(0, len(x)) :] for x in a[:-3]] + ["", "a", "\0"]
    assert jaro_winkler_many(a, b).tolist() == [jaro_winkler(x, y) for x, y in zip(a, b)]
    assert jaro_winkler_many([], []).tolist() == []


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.6, 0.9])
def test_similar_documents_beside_brute_force(spark, threshold):
    rng, texts = random.Random(5), set()
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(3, 30))] for _ in range(12)]
    for words in base:
        for _ in range(4):
            edited = list(words)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice("uvwxyz") * 2
            texts.add(" ".join(edited))
    texts = sorted(texts) + ["", "!!"]
    df = spark.createDataFrame([(t,) for t in texts], "document string").withColumn("doc", metadata_match.doc_key(F.col("document")))
    named = {r.doc: r.document for r in df.collect()}
    found = {tuple(sorted((named[r.doc_a], named[r.doc_b]))): r.score for r in metadata_match.similar_documents(metadata_match.documents_of(df), threshold).collect()}
    count = lambda t: {w: t.split().count(w) for w in t.split() if w.isalnum()}
    truth = {(a, b): s for a, b in itertools.combinations(sorted(texts), 2) if (s := bm25_cosine(count(a), count(b))) >= threshold}
    assert found.keys() == truth.keys() and all(abs(found[k] - truth[k]) < 1e-9 for k in truth)


def test_contracts_align_at_highest_common_token(spark):
    doc = lambda w: " ".join(f"{w}{i}" for i in range(30))
    data = [("base", "a", "1", doc("x")), ("base", "a", "2", doc("y")), ("base", "b", "1", doc("x")), ("base", "b", "2", doc("z")), ("base", "c", "9", doc("y")), ("solana", "S", "q", doc("y")), ("base", "d", "1", doc("x"))]
    anchors = spark.createDataFrame(data, "chain string, contract_address string, token_id string, document string")
    found = {(r.contract_a, r.contract_b) for r in metadata_match.similar_contracts(anchors, 0.6).collect()}
    # a and b share tokens 1 and 2: 2 decides, and differs; a and c share none: their tops agree; S compares by tops
    assert found == {("a", "c"), ("a", "d"), ("b", "d"), ("a", "S"), ("c", "S")}


def test_seed_edges(spark):
    tokens = source.tokens(snap(spark, [("ethereum", "0xseed", "1", "", "s", "p", ""), ("ethereum", "0xdup", "1", "", "s", "p", ""), ("base", "0xb", "1", "", "other", "p", "")]))
    seeds = spark.createDataFrame([("ethereum", "0xseed")], "chain string, contract_address string")
    edges = uri_match.seed_uri_edges(tokens, seeds, "token_uri_norm", "token_uri").unionByName(uri_match.seed_uri_edges(tokens, seeds, "image_uri_norm", "image_uri"))
    scale = lambda e: rows(uri_match.seed_scale(e), "dimension", "candidate_contracts", "candidate_nfts")
    assert scale(edges) == [("image_uri", 2, 2), ("token_uri", 1, 1), ("total", 2, 2)]
    assert scale(uri_match.image_minus_token(edges)) == [("image_uri", 1, 1), ("token_uri", 1, 1), ("total", 2, 2)]
    short = lambda apart: rows(uri_match.seed_uri_scale(tokens, seeds, apart), "dimension", "candidate_contracts", "candidate_nfts")
    assert short(False) == scale(edges) and short(True) == scale(uri_match.image_minus_token(edges))


def test_eager_rollup_beside_plain_join(spark):
    rng = random.Random(2)
    a = spark.createDataFrame([(rng.choice(["hot", "hot", "b", None]), rng.choice("xyz"), rng.choice([1, 2, None]), "clash") for _ in range(300)], "k string, g string, v long, other string")
    b = spark.createDataFrame([(rng.choice(["hot", "b", "c", None]), rng.choice("pq"), rng.choice([3, None]), 1) for _ in range(50)], "k string, h string, w long, other int")
    found = eager.eager_join_rollup(a, b, ["k"], ["g"], ["h"], ["v"], ["w"])
    plain = a.drop("other").join(b.drop("other"), "k").groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum_v"), F.sum("w").alias("sum_w"))
    assert rows(found, "g", "h", "n", "sum_v", "sum_w") == rows(plain)
    assert eager.eager_join_rollup(a.limit(0), b, ["k"], ["g"], ["h"]).count() == 0
    many = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("g"))
    assert rows(eager.eager_join_rollup(many, b, ["k"], ["g"], ["h"]).agg(F.sum("n"))) == [(40_000 * b.filter("k = 'hot'").count(),)]


def test_representative_names(spark):
    data = [("Base ", "0xA", n) for n in ["b", "a", "b", "a", " ", None]] + [("base", "0xa", "c"), ("solana", "Ab", "x"), ("solana", "ab", "y"), ("base", None, "z"), ("base", "0xn", None)]
    df = spark.createDataFrame(data, "chain string, contract_address string, name_norm string").withColumn("n", F.lit("clash"))
    assert rows(representative.representative_names(df)) == [("base", "0xa", "a"), ("solana", "Ab", "x"), ("solana", "ab", "y")]
    assert representative.representative_names(df.limit(0)).count() == 0


def test_shred(spark):
    text = '{"a":[{"t":1,"m":[{"k":"v"}]},null,3,[{"z":true}]],"o":{"l":[{"x":null}]}}'
    df = spark.createDataFrame([(1, text), (2, "bad"), (3, None), (4, '"[{\\"q\\":1}]"'), (5, "[]"), (6, "[" * 100_000), (7, '{"a":NaN}'), (8, '""')], "id long, doc string")
    nodes = shred.shred(df.withColumn("kind", F.lit("clash")), "id", "doc")
    assert rows(shred.array_objects(nodes, "id")) == [(1, "$", "$.a[0]"), (1, "$", "$.a[3][0]"), (1, "$.a[0]", "$.a[0].m[0]"), (1, "$.o", "$.o.l[0]"), (4, "$", "$[0]")]
    table = shred.entity_table(shred.entities(nodes, "id").filter("in_array"), "id", "a", ["t", "z"])
    assert rows(table, "node_path", "m_t", "m_z") == [("$.a[0]", "1", None), ("$.a[3][0]", None, "true")]
    assert shred.array_objects(shred.shred(df.limit(0), "id", "doc"), "id").count() == 0


def test_shred_holds_at_any_depth_and_length_of_numbers(spark):
    deep = '{"a":' + "[" * 100_000 + '{"b":1}' + "]" * 100_000 + "}"
    objects = '[{"a":' * 1_500 + "1" + "}]" * 1_500
    data = [(1, deep), (2, '[{"n":' + "9" * 5_000 + "}]"), (3, deep[:-1]), (4, objects)]
    nodes = shred.shred(spark.createDataFrame(data, "id long, doc string"), "id", "doc", budget=1_000)
    found = rows(shred.array_objects(nodes, "id"))
    assert [x for x in found if x[0] < 4] == [(1, "$", "$.a" + "[0]" * 100_000), (2, "$", "$[0]")]
    assert {(len(x[1]), len(x[2])) for x in found if x[0] == 4} == {(max(1, 5 * i - 1), 5 * i + 4) for i in range(1_500)}
    assert [r.m_n for r in shred.entity_table(shred.entities(nodes, "id").filter("id = 2 and in_array"), "id", None, ["n"]).collect()] == ["9" * 5_000]


@pytest.mark.parametrize("text", ['{"a":[1,2.5,{"b":null,"c":[true,false]}],"d":"x\\n\\u00e9"}', "[]", "{}", "[1,]", '{"a"}', '{"a":}', "[1 2]", '"x"', "-0", "01", "[-]", "[1.]", "[1e5,1E-3]", "[[],{}]", "[1] x", "", "{,}", '["a"', "[NaN]", "[1e999]", '{"a"::1}', '{"a":1,"a":2}'])
def test_deep_parser_beside_the_usual_one(text):
    import json

    def of(parser):
        try:
            return repr(parser(text))
        except ValueError:
            return "no JSON"

    assert of(shred._loads_deep) == of(lambda t: json.loads(t, **shred._LOADS))


def test_shred_of_a_long_document(spark):
    import json

    doc = json.dumps({"rows": [{"i": i, "s": "x" * 20} for i in range(20_000)]})
    found = shred.array_objects(shred.shred(spark.createDataFrame([(1, doc)], "id long, doc string"), "id", "doc"), "id")
    assert found.count() == 20_000


MOVES = "tx_hash string, chain string, contract_address string, token_id string, from_address string, to_address string, block_ts timestamp_ntz, block_number long, is_mint boolean, gas_native double, fee_payer string, mint_payment_native double, mint_payment_usd double, mint_payment_receiver string, ingested_at timestamp_ntz"


def moves(spark, steps):
    """(token, from, to, time in seconds or None)."""
    from datetime import datetime, timedelta

    at = lambda s: None if s is None else datetime(2024, 1, 1) + timedelta(seconds=s)
    data = [(f"t{i}", "base", "0xC", t, a, b, at(s), s, False, 1.0, a, None, None, None, at(0)) for i, (t, a, b, s) in enumerate(steps)]
    return events.movements(spark.createDataFrame(data, MOVES))


def test_movements_once_and_disposals(spark):
    moved = moves(spark, [("1", "a", "b", 1), ("1", "b", "c", 1), ("1", "b", "c", 5), ("2", None, "b", None), ("1", "c", "b", 9)])
    found = {(r.address, r.token_id, (r.acquired_at.second, r.disposed_at and r.disposed_at.second)) for r in events.first_disposals(moved).collect()}
    assert found == {("b", "1", (1, 5)), ("c", "1", (1, 9)), ("c", "1", (5, 9)), ("b", "1", (9, None))}
    assert events.movements(spark.createDataFrame([], MOVES)).count() == 0
    twice = spark.createDataFrame([("T", "base", "0xC ", "1", "a", "b", None, None, None, g, None, None, None, None, None) for g in (2.0, None)], MOVES)
    assert events.movements(twice).count() == 1


def brute_components(edges):
    reach = {v: {v} for e in edges for v in e}
    for _ in reach:
        for a, b in edges:
            for v in reach:
                if a in reach[v]:
                    reach[v].add(b)
    groups = {frozenset(w for w in reach[v] if v in reach[w]) for v in reach}
    return {(min(g), v) for g in groups if len(g) > 1 for v in g}


def test_strong_components_beside_brute_force(spark):
    rng = random.Random(4)
    names = [f"v{i:02}" for i in range(24)]
    edges = sorted({(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(34)) if a != b})
    df = spark.createDataFrame([("base", "0xc", a, b) for a, b in edges], "chain string, contract_address string, src string, dst string")
    assert {(r.component, r.v) for r in graph.strong_components(df).collect()} == brute_components(edges)
    assert graph.strong_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("whole", [0, 3, 10**6])
def test_strong_components_of_whole_contracts_and_in_rounds(spark, whole):
    rng, data = random.Random(12), []
    for c in range(6):
        data += [("base", f"c{c}", f"v{rng.randint(0, 14):02}", f"v{rng.randint(0, 14):02}") for _ in range(rng.choice([2, 12, 25, 40]))]
    data += [("base", "ring", f"r{i:03}", f"r{(i + 1) % 40:03}") for i in range(40)]
    edges = spark.createDataFrame(data, "chain string, contract_address string, src string, dst string")
    truth = set()
    for c in {d[1] for d in data}:
        own = {(d[2], d[3]) for d in data if d[1] == c}
        reach = {v: {v} for e in own for v in e}
        for _ in reach:
            for a, b in own:
                reach[a] |= reach[b]
        for _ in reach:
            for a, b in own:
                reach[a] |= reach[b]
        for v in reach:
            group = sorted(w for w in reach[v] if v in reach[w])
            if len(group) > 1:
                truth.add((c, group[0], v))
    assert set(rows(graph.strong_components(edges, whole), "contract_address", "component", "v")) == truth
    assert graph.strong_components(edges.limit(0), whole).count() == 0


def test_long_chain_of_moves_is_searched_at_once(spark):
    n = 10_000
    edges = spark.range(n).selectExpr("'base' chain", "'c' contract_address", "format_string('%06d', hash(id) & 1048575) || '-' || id src", "format_string('%06d', hash(id + 1) & 1048575) || '-' || (id + 1) dst")
    assert graph.strong_components(edges).count() == 0
    back = edges.unionByName(edges.orderBy("src").limit(0)).unionByName(spark.sql(f"select 'base' chain, 'c' contract_address, format_string('%06d', hash({n}L) & 1048575) || '-' || {n} src, format_string('%06d', hash(0L) & 1048575) || '-0' dst"))
    assert graph.strong_components(back).count() == n + 1


def test_group_pairs_are_sampled_without_making_all(spark):
    data = [("big", i) for i in range(300)] + [("small", i) for i in range(4)] + [("one", 1), ("small", 3), (None, 1), ("big", None)]
    members = spark.createDataFrame(data, "g string, m int")
    found = rows(sampling.sample_group_pairs(members, "g", "m", 50))
    assert len(found) == len(set(found)) == 56 and all(a < b for _, a, b in found)
    assert {(a, b) for g, a, b in found if g == "small"} == set(itertools.combinations(range(4), 2))
    assert found == rows(sampling.sample_group_pairs(members.repartition(3), "g", "m", 50))
    assert len({x for g, *p in found if g == "big" for x in p}) > 60
    assert sampling.sample_group_pairs(members.limit(0), "g", "m", 5).count() == 0


def test_handovers_and_fans(spark):
    moved = moves(spark, [("1", "a", "b", 1), ("1", "b", "c", 2), ("1", "x", "y", 3), ("2", "a", "b", 1), ("2", "b", "a", 2), ("3", "a", "d", 1)])
    assert rows(graph.handovers(moved), "token_id", "path") == [("1", "a>b>c")]
    edges = graph.address_edges(moved)
    assert rows(graph.fans(edges, 2), "address", "direction", "others") == [("a", "out", 2), ("b", "out", 2)]


def test_ranks_gini_and_top_share(spark):
    rng = random.Random(6)
    data = [("k" if i % 3 else None, rng.randint(0, 9), i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, v long, i long")
    found = {r.i: (r["rank"], r.rank_of) for r in ranking.with_rank(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    for k in ("k", None):
        own = sorted((v, i) for kk, v, i in data if kk == k)
        assert all(found[i] == (n + 1, len(own)) for n, (_, i) in enumerate(own))
    x = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 4.0), ("b", 0.0), ("c", None)], "k string, v double")
    assert rows(ranking.gini(x, ["k"], "v")) == [("a", 3, 2 / 3), ("b", 1, 0.0)]
    assert rows(ranking.top_share(df.filter("k = 'k'"), ["k"], "v", "i"), "members", "top_members")[0][1] == -(-sum(1 for d in data if d[0]) // 10)


def test_nearest_outside_beside_brute_force(spark):
    rng = random.Random(8)
    at = [(rng.choice("pq"), rng.randint(0, 400)) for _ in range(60)]
    win = sorted({(rng.choice("pqr"), f, f + rng.randint(0, 30)) for f in range(10, 390, 40)})
    found = rows(events.nearest_outside(spark.createDataFrame(win, "k string, first long, last long"), spark.createDataFrame([*at, ("p", None)], "k string, at long"), "k", 25))
    near = lambda k, lo, hi: [b for kk, b in at if kk == k and lo <= b <= hi]
    assert found == sorted([(k, f, l, max(near(k, f - 25, f - 1), default=None), min(near(k, l + 1, l + 25), default=None)) for k, f, l in win], key=str)


def test_sampling(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), ("cold", 1), (None, 3)], "s string, i long")
    one, two = (rows(sampling.sample_per_scope(df, ["s"], ["i"], 5)) for _ in range(2))
    assert one == two and len([r for r in one if r[0] == "hot"]) == 5 and len([r for r in one if r[0] == "cold"]) == 1
    assert one != rows(sampling.sample_per_scope(df, ["s"], ["i"], 5, "other"))
    drawn = sampling.balanced_targets({"a": 1, "b": 100, "c": 100}, 31)
    assert drawn["a"] == 1 and sum(drawn.values()) == 31 and abs(drawn["b"] - drawn["c"]) <= 2
    assert sum(sampling.balanced_targets({"a": 2, "b": 3}, 100).values()) == 5


def test_staging(spark):
    table = spark.createDataFrame([("1", "old", None), (None, "n", None)], "k string, a string, b string")
    batch = spark.createDataFrame([("1", "new", "B"), ("2", "x", None), ("2", "y", None), (None, "m", None)], "k string, a string, b string")
    assert rows(staging.insert_absent(table, batch, ["k"], ["a"])) == [("1", "old", None), ("2", "x", None), (None, "n", None)]
    unique = batch.filter("k = '1'")
    assert rows(staging.upsert(table.filter("k is not null"), unique, ["k"])) == [("1", "new", "B")]
    assert rows(staging.remove_listed(table, unique, ["k"]), "k") == [(None,)]


def test_publish_and_cache(spark, tmp_path):
    df = spark.range(3)
    at = str(tmp_path / "out")
    sinks.publish({"a": df, "b": df}, at)
    with pytest.raises(FileExistsError):
        sinks.publish({"a": df}, at)
    sinks.publish({"a": spark.range(5)}, at, force=True)
    assert spark.read.parquet(f"{at}/a").count() == 5
    made = []
    make = lambda: made.append(1) or spark.range(4)
    for mark in ("m1", "m1", "m2"):
        assert sinks.cached(spark, str(tmp_path / "cache"), mark, make).count() == 4
    assert len(made) == 2
    sinks.write_manifest(spark, str(tmp_path / "manifest.json"), {"rows": 3})
    assert '"rows": 3' in sinks.read_text(spark, str(tmp_path / "manifest.json"))
    assert sinks.markdown(spark.createDataFrame([("a|b", None)], "x string, y string")).splitlines()[-1] == "| a\\|b |  |"


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_beside_plain_join(spark, how):
    from twinledger.operators.skew import hot_keys, spread_join

    left = spark.range(3_000).selectExpr("id", "if(id % 3 = 0, 7, if(id % 50 = 1, null, id % 40)) k")
    right = spark.range(60).selectExpr("id % 20 k", "id v")
    hot = hot_keys(left, ["k"], share=1 / 10, least=100)
    assert [r.k for r in hot.collect()] == [7] and hot.first()["__parts"] >= 3
    assert hot_keys(left, ["k"]) is None
    assert rows(spread_join(left, right, ["k"], hot, ["id"], how)) == rows(left.join(right, "k", how))
    joined = spread_join(left, right, ["k"], hot, ["id"])
    per_part = left.join(hot, "k").groupBy(F.pmod(F.xxhash64("id"), "__parts")).count()
    assert max(r["count"] for r in per_part.collect()) < 600 and joined.columns == ["k", "id", "v"]


def test_write_text_replaces_in_one_step(spark, tmp_path):
    path = f"{tmp_path}/mark"
    for text in ("one", "two"):
        sinks.write_text(spark, path, text)
        assert sinks.read_text(spark, path) == text
    fine = sinks.fingerprint(spark, [str(tmp_path)])
    assert fine == sinks.fingerprint(spark, [str(tmp_path)])


def test_scopes_keep_tables_of_other_runs(spark):
    from twinledger import runtime

    outer = runtime.land(spark.range(3), "outer")
    with runtime.landing_scope(spark):
        inner = runtime.land(spark.range(2), "inner")
        assert runtime.release_all(spark) == 1 and outer.count() == 3
        inner = runtime.land(spark.range(2), "inner")
        assert inner.count() == 2
    with pytest.raises(Exception, match="exist|FILE"):
        spark.read.parquet(inner.landed_at).count()
    assert outer.count() == 3
    with runtime.landing_scope(spark):
        result = runtime.land(spark.range(4), "result", outer=True)
    assert result.count() == 4
    runtime.release(outer, result)


def test_landed_tables_are_released(spark):
    from twinledger import runtime

    a, b = runtime.land(spark.range(3), "a"), runtime.land(spark.range(4).withColumn("p", F.col("id") % 2), "b", "p")
    assert a.count() == 3 and b.columns == ["id", "p"] and b.count() == 4
    runtime.release(a)
    assert runtime.release_all(spark) >= 1 and runtime.release_all(spark) == 0


def test_receipts_fill_what_moves_lack(spark):
    moved = moves(spark, [("1", "a", "b", 1), ("2", "a", "b", 2)]).withColumn("gas_native", F.when(F.col("tx_hash") == "t0", F.col("gas_native")))
    receipts = spark.createDataFrame([("T1", 5.0, "p"), (" t1 ", 7.0, "o"), ("t0", 9.0, "x"), (None, 1.0, "y")], "tx_hash string, gas_native double, fee_payer string")
    assert rows(events.with_receipts(moved, receipts), "tx_hash", "gas_native", "fee_payer") == [("t0", 1.0, "a"), ("t1", 7.0, "a")]
    assert events.with_receipts(moved, receipts).columns == moved.columns


def test_sampled_pairs_have_pictures(spark):
    pairs = spark.createDataFrame([("base", "a", "base", b, 1.0) for b in "bcde"], "chain_a string, contract_a string, chain_b string, contract_b string, score double")
    tokens = source.tokens(snap(spark, [("base", c, t, "", "", i, "") for c, t, i in [("a", "1", ""), ("a", "2", "pa"), ("b", "1", "pb"), ("c", "1", "pc"), ("d", "1", "")]]))
    assert rows(sampling.sample_pairs_with_pictures(pairs, tokens, 5), "contract_b", "image_a", "image_b") == [("b", "pa", "pb"), ("c", "pa", "pc")]
    assert sampling.sample_pairs_with_pictures(pairs, tokens, 1).count() == 1
