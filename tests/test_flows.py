"""Value flows, states of evidence and the replies they are read from: nulls, ties, repeated rows, empty tables and clashing columns."""

import json

import pytest
from pyspark.sql import functions as F

from twinledger.operators import evidence, flows
from twinledger.sources import providers, sinks

FLOW = "chain string, tx_hash string, event_id string, from_address string, to_address string, amount double, at long"
MOVE = "chain string, contract_address string, tx_hash string, token_id string, from_address string, to_address string, is_mint boolean, mint_payment_native double, mint_payment_receiver string"


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def test_flows_are_tidied_and_classified_once(spark):
    data = [("Base ", "0xT1", "e", "0xA", "0xB", 1.0, 1), ("base", "0xt1", "e", "0xa", "0xb", None, 1), ("base", "t2", None, "0xb", "0xa", 2.0, 1), ("base", "t3", None, "0xa", "0xc", 3.0, 1), ("base", "t4", None, "0xx", "0xy", 3.0, 1), ("base", None, None, "0xa", "0xb", 1.0, 1), ("base", "t5", None, "0xa", "0xA", 1.0, 1), ("base", "t6", None, None, "0xb", 1.0, 1)]
    tidy = flows.tidy_flows(spark.createDataFrame(data, FLOW))
    assert tidy.count() == 5
    operators = spark.createDataFrame([("base", "0xa"), ("base", "0xa"), ("base", "0xb"), ("base", None)], "chain string, address string").withColumn("kind", F.lit("clash"))
    found = flows.merged(flows.classified(tidy, operators))
    assert rows(found, "tx_hash", "amount", "kind") == [("0xt1", 1.0, "revenue_backflow"), ("t2", 2.0, "revenue_backflow"), ("t3", 3.0, "withdrawal")]
    assert rows(flows.classified(tidy, operators.filter("address = '0xb'")), "tx_hash", "kind") == [("0xt1", "funding"), ("0xt1", "funding"), ("t2", "withdrawal")]
    both = spark.createDataFrame([("base", "t", None, "a", "b", None, "funding"), ("base", "t", None, "a", "b", 2.0, "withdrawal"), ("base", "u", "1", "a", "b", None, "funding")], "chain string, tx_hash string, event_id string, from_address string, to_address string, amount double, kind string")
    assert rows(flows.merged(both), "tx_hash", "amount", "kind") == [("t", 2.0, "revenue_backflow"), ("u", None, "funding")]
    assert flows.merged(flows.classified(tidy.limit(0), operators)).count() == 0


def test_mint_payments_by_flows(spark):
    mint = lambda tx, token, to, paid=None, receiver=None, minted=True: ("base", "0xc", tx, token, None, to, minted, paid, receiver)
    moved = spark.createDataFrame([mint("t1", "1", "a"), mint("t1", "2", "a"), mint("t2", "3", "a", 5.0, "own"), mint("t3", "4", "b"), mint("t4", "5", "c"), mint(None, "6", "a"), mint("t1", "7", "a", minted=False)], MOVE)
    flow = lambda tx, a, b, x: ("base", tx, None, a, b, x, 1)
    coin = spark.createDataFrame([flow("t1", "a", "shop", 4.0), flow("t1", "a", "shop", 2.0), flow("t1", "shop", "a", 1.0), flow("t2", "a", "shop", 3.0), flow("t3", "b", "x", 1.0), flow("t3", "b", "y", 1.0), flow("t4", "c", "x", None)], FLOW)
    assert rows(flows.mint_outflows(moved, coin), "tx_hash", "buyer", "mints", "paid", "receiver", "paid_each") == [("t1", "a", 2, 6.0, "shop", 3.0), ("t2", "a", 1, 3.0, "shop", 3.0)]
    found = {r.token_id: (r.mint_payment_native, r.mint_payment_receiver) for r in flows.with_mint_payments(moved, coin).collect()}
    assert found == {"1": (3.0, "shop"), "2": (3.0, "shop"), "3": (5.0, "own"), "4": (None, None), "5": (None, None), "6": (None, None), "7": (None, None)}
    assert flows.mint_outflows(moved.limit(0), coin).count() == 0


def test_facts_break_ties_by_address(spark):
    moved = spark.createDataFrame([("base", "c", "t", "1", "0x" + "0" * 40, "a", True, None, None), ("base", "c", "t", "1", "a", "b", None, None, None), ("base", "d", "t", None, None, None, False, None, None)], MOVE)
    coin = spark.createDataFrame([("base", "c", "z", 2.0), ("base", "c", "b", 1.0), ("base", "c", "b", 1.0), ("base", "c", None, 9.0), ("base", "c", "y", None)], "chain string, contract_address string, to_address string, amount double")
    found = flows.facts(moved, coin, ["chain", "contract_address"])
    assert rows(found, "contract_address", "mints", "transfers", "nfts", "addresses", "flows_in", "receiver", "receiver_share") == [("c", 1, 1, 1, 2, 4.0, "b", 0.5), ("d", 0, 1, 0, 0, None, None, None)]


def test_window_and_controllers(spark):
    coin = spark.createDataFrame([("base", f"t{i}", None, "a", "b", 1.0, at) for i, at in enumerate([1, 5, 10, 26, None])], FLOW)
    spans = spark.createDataFrame([("base", 10, 20)], "chain string, first long, last long")
    assert rows(flows.in_window(coin, spans, 5), "at") == [(10,), (5,)]
    word = "0x" + "0" * 24 + "ab" * 20
    named = spark.createDataFrame([("base", "c", "0x" + "AB" * 20, word, None), ("base", "d", "0x" + "0" * 40, "junk", " ")], "chain string, contract_address string, owner string, admin string, creator string")
    assert rows(flows.controllers_of(named, ["owner", "admin", "creator"]), "contract_address", "controller", "fields") == [("c", "0x" + "ab" * 20, "admin,owner")]
    who = spark.createDataFrame([("base", "s", "0xA"), ("base", "s", None), ("base", "c", " 0xa"), ("base", "n", "0xb")], "chain string, contract_address string, controller string")
    pairs = spark.createDataFrame([("base", "s", "base", "c"), ("base", "s", "base", "n"), ("base", "s", "base", "c")], "seed_chain string, seed_address string, candidate_chain string, candidate_address string")
    assert rows(flows.shared_controllers(who, who, pairs)) == [("base", "s", "base", "c", "0xa")]


def test_states_of_evidence(spark):
    cases = [("complete", "empty", None), ("empty", "empty", "empty"), ("complete", "truncated", "not_requested"), ("failed", "truncated", None), (None, None, None), ("truncated", "complete", "empty")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, c string")
    kinds = [F.col(c) for c in "abc"]
    got = df.orderBy("i").select(evidence.combined_state(*kinds).alias("s"), evidence.is_complete(kinds).alias("c"), evidence.is_complete(kinds, [F.col("i")], F.col("i") == 3).alias("x")).collect()
    assert [r.s for r in got] == ["complete", "empty", "not_requested", "failed", "empty", "truncated"]
    assert [r.c for r in got] == [True, True, False, False, True, False] and [r.x for r in got] == [True, False, False, True, False, False]
    states = df.select(evidence.page_state(F.col("i"), F.col("i") > 3, F.col("i") == 5).alias("s"))
    assert rows(states) == [("complete",)] * 3 + [("empty",), ("failed",), ("truncated",)]
    counted = {(r.kind): (r.complete, r.empty, r.truncated, r.failed, r.not_requested) for r in evidence.state_counts(df, [], ["a", "c"]).collect()}
    assert counted == {"a": (2, 1, 1, 1, 0), "c": (0, 2, 0, 0, 1)}
    why = spark.createDataFrame([(1, ["p", "p", None]), (1, None), (2, [])], "k int, w array<string>")
    assert rows(evidence.reason_counts(why, ["k"], "w")) == [(1, "p", 2)]


def test_populations_only_of_complete_evidence(spark):
    holders = spark.createDataFrame([("a", "1", "2"), ("a", "1", "1"), ("a", "2", "0"), ("a", "3", None), ("b", "1", "1"), ("b", "", None), ("c", "1", "1")], "k string, token_id string, balance string")
    states = spark.createDataFrame([("a", "complete"), ("b", "complete"), ("c", "truncated"), ("d", "empty")], "k string, state string")
    assert rows(evidence.population(holders, states, ["k"])) == [("a", 2), ("b", None), ("c", None), ("d", 0)]


def test_sources_are_chosen_never_mixed(spark):
    data = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    state = lambda *r: spark.createDataFrame(list(r), "k string, state string")
    first, second = (data(("a", 1), ("x", 1)), state(("a", "complete"), ("b", "empty"), ("c", "failed"))), (data(("a", 2), ("b", 2), ("c", 2)), state(("a", "complete"), ("b", "complete"), ("c", "truncated")))
    assert rows(evidence.first_source([first, second], ["k"])) == [("a", 1), ("c", 2)]
    quotes = spark.createDataFrame([("A", "x", 1.0), ("A", "x", 2.0), ("B", "x", 1.0), ("B", "y", 1.0), ("C", None, None)], "s string, who string, v double")
    assert rows(evidence.unambiguous(quotes, ["s"], "who", "v")) == [("A", 1.0)]
    flags = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("c", None)], "k string, excluded boolean")
    assert rows(evidence.without_listed(data(("a", 1), ("b", 1), ("c", 1)), flags, ["k"]), "k") == [("b",), ("c",)]


def test_malformed_replies_give_no_rows(spark):
    pages = spark.createDataFrame([("base", "0xc", "s", "c", p) for p in ("bad", None, "{}", "[]", json.dumps({"result": None}), json.dumps({"result": {"transfers": [{}]}}))], "chain string, contract_address string, signature string, collection string, payload string")
    for read in (providers.native_moves, providers.listed_transfers, providers.market_sales, providers.collection_assets, providers.sol_moves, providers.transfers, providers.holders, providers.sales):
        assert read(pages).count() == 0 and read(pages.limit(0)).count() == 0


def test_coin_moves_fall_back_on_balances_of_two_only(spark):
    def tx(pre, post, steps=(), inner=()):
        step = lambda a, b, n: {"parsed": {"type": "transfer", "info": {"source": a, "destination": b, "lamports": n}}}
        return json.dumps({"transaction": {"message": {"accountKeys": [{"pubkey": k} for k in "ABC"], "instructions": [step(*s) for s in steps]}}, "meta": {"fee": 5, "preBalances": pre, "postBalances": post, "innerInstructions": [{"instructions": [step(*s) for s in inner]}]}})

    data = [("two", tx([100, 0, 0], [85, 10, 0])), ("three", tx([100, 0, 0], [75, 10, 10])), ("fee", tx([100, 0, 0], [95, 0, 0])), ("short", tx([100], [0])), ("told", tx([1], [1], [("A", "B", 0), ("A", "B", 10**9)], [("B", "C", 5 * 10**8), ("", "C", 1)]))]
    found = rows(providers.sol_moves(spark.createDataFrame(data, "signature string, payload string")))
    assert found == [("told", "instruction:1", "A", "B", 1.0), ("told", "instruction:2", "B", "C", 0.5), ("two", "balance:0:1", "A", "B", 1e-8)]


def test_report_tree_failures_and_resumed_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    files = sinks.write_tree(spark, f"{tmp_path}/tree", {"summary": {"all": df}})
    assert json.loads(sinks.read_text(spark, files[0]))["rows"] == [{"n": 1, "t": "a|b"}, {"n": 2, "t": None}] and "a\\|b" in sinks.read_text(spark, files[1])
    with pytest.raises(ValueError):
        sinks.write_tree(spark, f"{tmp_path}/big", {"summary": {"all": df}}, most=1)
    for run in ("one", "two"):
        sinks.append_failures(df, f"{tmp_path}/failures.jsonl", run)
    assert spark.read.json(f"{tmp_path}/failures.jsonl").groupBy("run").count().count() == 2
    asked = []

    def make(keys):
        asked.append({r.k for r in keys.collect()})
        return keys.filter("k <> 2").select("k", F.lit("row").alias("v"))

    want = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    assert rows(sinks.resumed(spark, f"{tmp_path}/kept", want(1, 2, 2), ["k"], make), "k") == [(1,)]
    with pytest.raises(RuntimeError):
        sinks.resumed(spark, f"{tmp_path}/kept", want(1, 2, 3), ["k"], lambda keys: (_ for _ in ()).throw(RuntimeError("lost")))
    assert rows(sinks.resumed(spark, f"{tmp_path}/kept", want(2, 3), ["k"], make), "k") == [(3,)] and asked == [{1, 2}, {3}]


def test_whole_seed_run_with_cache(spark, tmp_path):
    from twinledger.plans import pipeline

    schema = "row_id long, chain string, contract_address string, token_id string, name_norm string, token_uri_norm string, image_uri_norm string, metadata_json string"
    spark.createDataFrame([(i, "base", f"0x{i}", "1", "same", "u", "", '{"a":"b c d"}') for i in range(4)], schema).write.parquet(f"{tmp_path}/snap")
    seeds = spark.createDataFrame([("Base", "0X0", 1, "m", "w", "f"), ("base", None, 1, "m", "w", "f")], "chain string, address string, seed_rank int, metric string, metric_window string, feed string")
    run = lambda **k: rows(pipeline.run_seeds(spark, f"{tmp_path}/snap", seeds, cache=f"{tmp_path}/cache", order="row_id", **k), "dimension", "candidate_contracts", "candidate_nfts")
    full = [("metadata", 3, 3), ("name", 3, 3), ("token_uri", 3, 3), ("total", 3, 3)]
    assert run(out=f"{tmp_path}/out") == full and run() == full
    assert "strongest_seeds" in sinks.read_text(spark, f"{tmp_path}/out/detail/strongest_seeds.md")
    some = spark.createDataFrame([("base", "0x2")], "chain string, contract_address string")
    assert run(candidates=some) == [(d, 1, 1) for d, *_ in full]
