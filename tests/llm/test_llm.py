import itertools
import math
import random
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinledger.functions.permutations import permuted
from twinledger.llm import components, copies, frequency, ledger, mixing, near_duplicates, packing, relations, residue, salience, similar
from tests.llm.residue_sentences import LEFT, LEFT_UNSEEN, SPOKEN, SPOKEN_UNSEEN
from twinledger.llm.tokens import Tokenizer, tokenised
from twinledger.runtime import shared_path

SNAP = "row_id long, name_norm string, token_uri_norm string, image_uri_norm string, metadata_json string, ingested_at timestamp_ntz"
WORD = re.compile(r"[^\W_]+")


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)


def snapshot(spark, **columns):
    n = max(map(len, columns.values()))
    pick = lambda c, i: columns[c][i] if c in columns else None
    return spark.createDataFrame([(i, *(pick(c, i) for c in ("name_norm", "token_uri_norm", "image_uri_norm", "metadata_json", "ingested_at"))) for i in range(n)], SNAP)


def edited(rng, n, vocabulary, length):
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    while len(out) < n:
        base = [rng.choice(words) for _ in range(length)]
        for _ in range(rng.randint(1, 6)):
            x = list(base)
            for _ in range(rng.randint(0, length // 4)):
                x[rng.randrange(len(x))] = rng.choice(words)
            rng.shuffle(x)
            out.append(" ".join(x))
    return out[:n]


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("seed", "vocabulary", "length"), [(1, 60, 30), (2, 2000, 60), (3, 30, 40)])
def test_similar_metadata_beside_brute_force(spark, seed, vocabulary, length):
    texts = [*edited(random.Random(seed), 250, vocabulary, length), None, "", "one two", "x" * 100_000]
    df = snapshot(spark, metadata_json=texts)
    sets = {i: s for i, t in enumerate(texts) if len(s := set(WORD.findall((t or "").lower()))) >= 20}
    truth = {(i, j) for i, j in itertools.combinations(sets, 2) if jaccard(sets[i], sets[j]) >= 0.7}
    found = near_duplicates.similar_metadata(df)
    got = rows(similar.row_pairs(found))
    assert len(got) == len(set(got)) and set(got) == truth
    per_row = {r.id: (r.links, r.copies) for r in similar.links(found).collect()}
    ends = Counter(x for p in truth for x in p)
    assert per_row == {i: (ends[i], sum(s == t for t in sets.values())) for i, s in sets.items()}


@pytest.mark.parametrize("block_rows", [250_000, 20])
def test_small_sets_and_hot_tokens(spark, block_rows):
    rng = random.Random(7)
    sets = [sorted({rng.randint(0, 40) for _ in range(rng.randint(1, 12))} | {1000 + i % 3}) for i in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)] + [(900, []), (901, None)], "row_id long, t array<long>")
    hashed = lambda d: d.select(F.col("row_id").alias("id"), F.transform("t", lambda x: F.xxhash64(x)).alias("tokens"))
    for t in (0.5, 0.8):
        found = similar.similar_sets(df, hashed, similar.Join(t, 6, block_rows))
        truth = {(i, j) for i, j in itertools.combinations(range(200), 2) if jaccard(set(sets[i]), set(sets[j])) >= t}
        assert set(rows(similar.row_pairs(found))) == truth


def test_long_sets_beside_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BATCH_TOKENS", 5000)
    rng, sets = random.Random(13), []
    for size in (150, 240, 260, 380, 500, 520, 760, 1020, 1500):
        base = [rng.randrange(4000) for _ in range(size)]
        for _ in range(5):
            keep = set(rng.sample(base, int(len(base) * rng.uniform(0.75, 1))))
            sets.append(keep | {rng.randrange(4000, 5000) for _ in range(rng.randint(0, size // 6))})
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "row_id long, t array<long>").coalesce(2)
    hashed = lambda d: d.select(F.col("row_id").alias("id"), F.transform("t", lambda x: F.xxhash64(x)).alias("tokens"))
    found = similar.similar_sets(df, hashed, similar.Join(0.7, 10))
    truth = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard(sets[i], sets[j]) >= 0.7}
    assert set(rows(similar.row_pairs(found))) == truth and len(truth) >= 40
    from types import SimpleNamespace

    one = np.arange(40_000, dtype=np.int64)
    batch = similar.pa.RecordBatch.from_arrays([similar.pa.array([1]), similar.pa.array([one.tolist()], similar.pa.list_(similar.pa.int64()))], ["id", "tokens"])
    ones = SimpleNamespace(value=np.ones(similar.SLOTS, np.int64))
    made = sum(b.num_rows for b in similar._signatures(similar.Join(0.7, 10), ones, ones, 10_000)([batch]))
    assert made < 4 * len(one)  # signatures grow as the tokens do


def test_similar_names_beside_brute_force(spark):
    rng = random.Random(9)
    names = [*("".join(rng.choice("abcé ") for _ in range(rng.randint(5, 16))) for _ in range(150)), "aaaaaaaa", "aaaaaaaaa", None, "", "short"]
    names += [n + "x" for n in names[:40]] + names[:10]
    grams = {n: {n[i : i + 3] for i in range(len(n) - 2)} for n in names if n and len(n) >= 8}
    first = {n: names.index(n) for n in grams}
    truth = {tuple(sorted((first[a], first[b]))) for a, b in itertools.combinations(grams, 2) if jaccard(grams[a], grams[b]) >= 0.5}
    assert set(rows(similar.row_pairs(near_duplicates.similar_names(snapshot(spark, name_norm=names))))) == truth


def test_copies_all_in_one_group(spark):
    texts = [" ".join(f"w{i}" for i in range(25))] * 60 + [" ".join(f"v{i}" for i in range(25))]
    found = near_duplicates.similar_metadata(snapshot(spark, metadata_json=texts))
    assert len(rows(similar.row_pairs(found))) == 60 * 59 // 2
    assert found.pairs.count() == 0
    assert rows(similar.links(found), "class_id", "copies", "links")[0] == (0, 60, 59)


def test_hot_classes_and_signatures_are_spread(spark, monkeypatch):
    """A class of a tenth of the rows and a token in a third of the sets, with limits low enough to bite."""
    from twinledger.operators import skew

    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(f"c{i}" for i in range(24))] * 40 + [" ".join([f"c{i}" for i in range(23)] + [f"x{k}"]) for k in range(20)]
    texts += [" ".join(rng.sample(words, 22) + (["hot", "warm"] if k % 3 == 0 else [])) for k in range(240)]
    texts += [t + " extra" for t in texts[60:160]]
    sets = {i: set(t.split()) for i, t in enumerate(texts)}
    truth = {(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.7}
    few = lambda rows, on, share=0, least=0: skew.hot_keys(rows, on, 1 / 100, 5)
    monkeypatch.setattr(similar, "hot_keys", few)
    source = snapshot(spark, metadata_json=texts)
    found = similar.similar_sets(source, near_duplicates.metadata_sets, similar.Join(0.7, 4, block_rows=3))
    assert set(rows(similar.row_pairs(found))) == truth
    counted = Counter(x for p in truth for x in p)
    assert {r.id: r.links for r in similar.links(found).collect()} == {i: counted[i] for i in sets}
    hot = few(found.members, ["rep"])
    parts = found.members.withColumnRenamed("rep", "k").join(hot.withColumnRenamed("rep", "k"), "k").groupBy("k", F.pmod(F.xxhash64("id"), "__parts")).count()
    assert max(r["count"] for r in parts.collect()) <= 15  # of the 40 copies


def test_similar_of_nothing(spark):
    df = snapshot(spark, metadata_json=[None]).limit(0)
    assert similar.row_pairs(near_duplicates.similar_metadata(df)).count() == 0
    assert similar.links(near_duplicates.similar_names(df)).count() == 0


def test_copies(spark):
    name = ["A  b", "a_B!", "a b", "a b", "a b", None, "a b", "b a"]
    uri = ["ipfs:x/1?q=2&p=1&", "IPFS/X 1?p=1&q=2", "ipfs:x/1?p=1", "ipfs:x/1?p=1&q=2&q=2", "ipfs:x/1?p=1&&q=2", "ipfs:x/1?p=1&q=2", "??", "ipfs:x/1?p=1&q=2"]
    day = [datetime(2024, 1 + i, 1) if i != 4 else None for i in range(8)]
    df = snapshot(spark, name_norm=name, token_uri_norm=uri, image_uri_norm=["i"] * 8, ingested_at=day).withColumn("copies", F.lit("clash"))
    assert rows(copies.copy_pairs(df)) == [(0, 1), (0, 4)]
    assert rows(copies.collapsed(df)) == [(0, 3), (2, 1), (3, 1), (7, 1)]
    assert copies.copy_pairs(df.limit(0)).count() == 0


def test_hot_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.lit("n").alias("name_norm"), F.lit("t").alias("token_uri_norm"), F.when(F.col("id") % 3 == 0, "rare").otherwise("i").alias("image_uri_norm"), F.lit(None).cast("timestamp_ntz").alias("ingested_at"))
    assert copies.copy_pairs(df).count() == 2998
    assert rows(copies.collapsed(df)) == [(0, 1000), (1, 2000)]


def test_ledger_takes_each_batch_once(spark):
    book = ledger.CopyLedger(spark, shared_path(spark, "test"))
    batch = lambda *r: spark.createDataFrame(list(r), "key_a long, key_b long, record long")
    book.take(batch((5, 5, 10), (5, 5, 12), (6, 6, 3)), "one")
    book.take(batch((5, 5, 4), (7, 7, 9)), "two")
    book.take(batch((5, 5, 1)), "two")
    book.take(batch(), "empty")
    assert rows(book.rows(), "key_a", "copies", "record") == [(5, 3, 4), (6, 1, 3), (7, 1, 9)]
    assert rows(book.rows({6}), "key_a") == [(6,)]


@pytest.mark.parametrize("step", ["write", "create", "rename", "sweep"])
def test_ledger_survives_a_failure_at_any_step(spark, monkeypatch, step):
    path = shared_path(spark, "test")
    batch = lambda *r: spark.createDataFrame(list(r), "key_a long, key_b long, record long")
    book = ledger.CopyLedger(spark, path, 4)
    book.take(batch((5, 5, 10), (6, 6, 3)), "one")
    before = rows(book.rows())

    class Failing:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            def fail(*_):
                raise OSError("lost")

            return fail if name == step else getattr(self.of, name)

    broken = ledger.CopyLedger(spark, path, 4)
    if step == "write":
        monkeypatch.setattr(ledger, "land", Failing(None).write)
    elif step == "sweep":
        monkeypatch.setattr(ledger.CopyLedger, "_sweep", Failing(None).sweep)
    else:
        broken._fs = Failing(broken._fs)
    with pytest.raises(OSError):
        broken.take(batch((5, 5, 1), (7, 7, 2)), "two")
    monkeypatch.undo()
    again = ledger.CopyLedger(spark, path, 99)
    if step != "sweep":
        assert rows(again.rows()) == before
    again.take(batch((5, 5, 1), (7, 7, 2)), "two")
    assert rows(again.rows(), "key_a", "copies", "record") == [(5, 2, 1), (6, 1, 3), (7, 1, 2)] and again.manifest()["count"] == 4


def test_two_writers_of_a_ledger(spark):
    path = shared_path(spark, "test")
    batch = spark.createDataFrame([(5, 5, 10)], "key_a long, key_b long, record long")
    one = ledger.CopyLedger(spark, path)
    stale = one.manifest()
    one.take(batch, "one")
    with pytest.raises(OSError):
        one._publish(stale | {"version": 1})
    assert rows(one.rows(), "copies") == [(1,)]


def test_hot_copies_are_not_shuffled(spark):
    from twinledger.runtime import land

    held = land(spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("key_a"), F.lit(0).cast("long").alias("key_b"), F.col("id").alias("record")), "held")
    book = held.groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("copies"), F.min("record").alias("record"))
    found = ledger.copies_of(held, book)
    assert found.count() == 2499
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = ledger.copies_of(held, book)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the rows' side that is shuffled lost its hot keys by a broadcast anti-join before
    assert "LeftAnti, BuildRight" in plan and plan.index("SortMergeJoin") < plan.index("LeftAnti")


def brute_groups(pairs):
    label = {v: v for p in pairs for v in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components_beside_brute_force(spark):
    rng = random.Random(11)
    pairs = [(f"n{rng.randint(0, 90):02}", f"n{rng.randint(0, 90):02}") for _ in range(60)] + [("s", "s")]
    df = spark.createDataFrame([*pairs, *pairs[:5], ("n1", None), (None, None)], "a string, b string").withColumn("label", F.lit(1))
    assert dict(rows(components.components(df, "a", "b"))) == brute_groups(pairs)
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_chain_and_star(spark):
    n, order = 300, list(range(300))
    random.Random(3).shuffle(order)
    chain = [(order[i], order[i + 1]) for i in range(n - 1)]
    star = [(1000, 1001 + i) for i in range(2500)]
    found = dict(rows(components.components(spark.createDataFrame(chain + star, "a long, b long"), "a", "b")))
    plan = components._jump(spark.range(5000).selectExpr("id v", "if(id < 4000, 0, id) label"), 5000)[0]
    assert plan.count() == 5000 and plan.filter("label = 0").count() == 4000 and "LeftAnti, BuildRight" in plan._jdf.queryExecution().executedPlan().toString()
    assert {found[i] for i in range(n)} == {0} and {v for k, v in found.items() if k >= 1000} == {1000}


def test_relation_groups(spark):
    data = [(" Base", "0xB", "base", "0xA "), ("base", "0xb", "solana", "Q"), ("solana", "q", "solana", "q"), ("base", " ", "base", "0xz"), ("base", "0xz", None, "0xz")]
    df = spark.createDataFrame(data, "seed_chain string, seed_address string, candidate_chain string, candidate_address string")
    assert rows(relations.contract_groups(df)) == [("base", "0xa", "base:0xa"), ("base", "0xb", "base:0xa"), ("solana", "Q", "base:0xa"), ("solana", "q", "solana:q")]


TEXTS = ['{"a": "Red red Blue7"}', "red green", "  ", None, "", "Straße éclair red", "red", "green " * 50, "___"]


def test_salience_beside_brute_force(spark, monkeypatch):
    bags = {i: Counter(WORD.findall(t.lower())) for i, t in enumerate(TEXTS) if t and t.strip(" ")}
    records = {t: sum(t in b for b in bags.values()) for b in bags.values() for t in b}
    totals = Counter(t for b in bags.values() for t in b.elements())
    grand, n = sum(totals.values()), len(bags)

    def best(score):
        out = {}
        for i, b in bags.items():
            scored = [(-round(s, 6), t) for t in b if records[t] >= 2 and not re.search(r"\d", t) and (s := score(b, t)) is not None]
            if scored:
                out[i] = min(scored)[1]
        return out

    def resid(b, t):
        e = sum(b.values()) * totals[t] / grand
        return (b[t] - e) / math.sqrt(e * (1 - sum(b.values()) / grand) * (1 - totals[t] / grand))

    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, metadata_json string")
    monkeypatch.setattr(salience, "LEAST_HOT", 2)
    for limit in (12_000_000, 80, 0):  # all terms broadcast, few, none
        monkeypatch.setattr(salience, "BROADCAST_BYTES", limit)
        found = salience.scored(df, "row_id", "metadata_json", ~F.col("term").rlike(r"\p{N}"), 2)
        assert dict(rows(salience.top_term(found, "idf"), "record", "term")) == best(lambda b, t: b[t] * math.log(n / records[t]))
        assert dict(rows(salience.top_term(found.withColumn("residual", F.round("residual", 6)), "residual"), "record", "term")) == best(resid)
    assert salience.scored(df.limit(0), "row_id", "metadata_json").count() == 0


def test_frequencies_beside_brute_force(spark):
    data = [(i, t, u) for i, (t, u) in enumerate(zip(TEXTS * 3, ["u1", None, " ", "u2", "U1", "u1", "", "u1", "u1"] * 3))]
    df = spark.createDataFrame(data, "row_id long, metadata_json string, token_uri_norm string").withColumn("item", F.lit("clash"))
    terms = [(i, w) for i, t, _ in data if t and t.strip(" ") for w in WORD.findall(t.lower())]
    uris = [(i, u) for i, _, u in data if u and u.strip(" ")]
    truth = []
    for field, pairs, n in (("metadata_json", terms, sum(1 for _, t, _ in data if t and t.strip(" "))), ("token_uri_norm", uris, len(uris))):
        for item in {x for _, x in pairs}:
            r = len({i for i, x in pairs if x == item})
            truth.append((field, item, sum(x == item for _, x in pairs), r, "rare" if r < 3 else "common" if r > 0.05 * n else "useful"))
    assert rows(frequency.snapshot_frequencies(df.repartition(5))) == sorted(truth, key=str)
    assert frequency.snapshot_frequencies(df.limit(0)).count() == 0


def test_runs_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        pairs = spark.createDataFrame([("f", "a", i // 2) for i in range(20)] + [("f", None, 1), ("g", "a", 1), ("f", "b", 1)], "field_name string, item string, record long").coalesce(1)
        assert rows(frequency.item_counts(pairs)) == [("f", "a", 20, 10), ("f", "b", 1, 1), ("g", "a", 1, 1)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_every_limit(rule):
    rng = np.random.default_rng(1)
    sizes = np.minimum(256, rng.lognormal(4, 1, 3000).astype(int))
    rules = packing.Rules(tokens_per_document=32, rule=rule)
    into = packing.best_fit(sizes, 256, rules)
    used, docs, cost = (np.bincount(into, w) for w in (sizes, np.ones(len(sizes)), sizes.astype(float) ** 2))
    assert used.max() <= 256 and docs.max() <= 8 and cost[docs > 1].max() <= 0.9 * 256**2
    if rule == "norm":
        assert used.sum() / (256 * len(used)) > 0.9
    assert packing.best_fit(np.array([], int), 256).tolist() == []
    assert packing.best_fit(np.array([5, 5, 5]), 10, packing.Rules(tokens_per_document=1)).tolist() == [0, 0, 1]
    # 98 and 2 fit by tokens and documents; the attention limit decides
    assert packing.best_fit(np.array([98, 2, 60, 38]), 100, packing.Rules(1, attention=1.0)).tolist() == [0, 0, 1, 1]
    assert packing.best_fit(np.array([98, 2, 60, 38]), 100, packing.Rules(1, attention=0.9)).tolist() == [0, 1, 1, 1]


def test_packing_keeps_every_token(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(1, 200))) for _ in range(80)] + ["", None, "word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash"))
    sizes = dict(rows(tokenised(df, ["doc_id"])))
    assert 81 not in sizes and sizes[80] == 0
    found = packing.pack(df, [(1, 64), (2, 1024)], shard_items=30).collect()
    for capacity, c in ((1, 64), (2, 1024)):
        own = [r for r in found if r.capacity_id == capacity]
        bins = Counter()
        for r in own:
            bins[r.shard, r.bin] += r.n
        assert max(bins.values()) <= c
        for doc, n in sizes.items():
            parts = sorted((r.start, r.n) for r in own if r.doc_id == doc)
            assert sum(n for _, n in parts) == n and len(parts) == max(1, -(-n // c)) and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:]))
    assert packing.pack(df.limit(0), [(1, 64)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [(1, 0)])


def test_tokens_decode_to_the_text(spark):
    import tiktoken

    text = "Größe ação 東京 <|endoftext|>\n\t x" * 20
    got = tokenised(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], as_list=True).first()
    import base64

    t = Tokenizer.default()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, t.read().splitlines())}
    assert tiktoken.Encoding("x", pat_str=t.pattern, mergeable_ranks=ranks, special_tokens={}).decode(list(got.tokens)) == text and got.n == len(got.tokens)


def test_totals_and_draws():
    sources = [mixing.Source("a", 0.5, 1, 100), mixing.Source("b", 0.3, 4, 10), mixing.Source("c", 0.2, 2, 0)]
    count = mixing.totals(sources)
    assert count[2] == 0 and count[1] <= 40 and count[0] <= 100 and abs(count[0] / sum(count) - 0.625) < 0.02
    drawn = mixing.draws(count, 16, 1)
    assert [sum(x) for x in zip(*drawn)] == count and all(sum(d) == 16 for d in drawn[:-1])
    assert mixing.totals([]) == [] and mixing.draws([0], 4, 1) == []
    assert mixing.totals([mixing.Source("a", 0.5, 1, 100), mixing.Source("b", 0.5, 2, 3)]) == [6, 6]
    assert mixing.totals([mixing.Source("a", 0.5, 1, 100), mixing.Source("b", 0.5, 2, 3)], 101) == [51, 6]


def test_draws_of_a_huge_corpus_are_few():
    count = [30_000_000_000, 5_000_000_000, 7]
    drawn = np.array(mixing.draws(count, 1024, 1))
    assert drawn.sum(axis=0).tolist() == count and len(drawn) <= mixing.MOST_SHARDS and (drawn >= 0).all()
    share = drawn[:, 0] / drawn.sum(axis=1)
    assert abs(share.mean() - 6 / 7) < 0.001 and 0 < share.std() < 0.001
    plan = mixing.Plan(drawn, np.array(count), np.array([10_000_000_000, 5_000_000_000, 7]), 7)
    k, block, passes = np.array([0, 0, 0, 1, 2]), np.array([5, 5, 9_999_999_999, 17, 6]), np.array([0, 2, 1, 0, 0])
    slot = plan.slots(k, block, passes)
    assert (slot // plan.sizes[k] == passes).all() and (permuted(slot % plan.sizes[k], plan.sizes[k], plan.key(k, passes)) == block).all()
    shard, position = plan.places(k, slot)
    assert (position < drawn.sum(axis=1)[shard]).all()


def test_every_place_of_a_mixture_is_taken_once():
    rng = np.random.default_rng(4)
    sizes, count = np.array([40, 9, 300]), np.array([73, 27, 200])
    plan = mixing.Plan(np.array(mixing.draws(count.tolist(), 32, 1)), count, sizes, 7)
    seen, taken = set(), Counter()
    for k in range(3):
        for p in range(-(-count[k] // sizes[k])):
            block = rng.permutation(sizes[k])
            slot = plan.slots(np.full(len(block), k), block, np.full(len(block), p))
            used = slot >= 0
            shard, position = plan.places(np.full(used.sum(), k), slot[used])
            seen.update(zip(shard.tolist(), position.tolist()))
            for s in shard:
                taken[int(s), k] += 1
    assert seen == {(s, i) for s, row in enumerate(plan.drawn) for i in range(row.sum())}
    assert all(taken[s, k] == n for s, row in enumerate(plan.drawn) for k, n in enumerate(row))


def test_mixture(spark):
    texts = [(i, "abc"[i % 3] if i % 7 else None, f"text number {i} " * (1 + i % 40)) for i in range(300)] + [(300, "a", None), (301, "a", "")]
    df = spark.createDataFrame(texts, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 1), ("none", 0.1, 3)], "source_name string, target_share double, max_repeats int")
    df = df.withColumn("doc_id", F.col("doc_id") * 1_000_000_007)  # ids far apart
    cut = mixing.blocks(df.filter("source = 'a'"), 32)
    tokens = {r.doc_id: list(r.tokens) for r in tokenised(df.filter("source = 'a'"), ["doc_id"], as_list=True).collect()}
    whole = [t for i in sorted(tokens) for t in tokens[i]]
    assert [t for r in sorted(cut.collect(), key=lambda r: r.block) for t in r.tokens] == whole
    mixed, shares = mixing.mixture(df, targets, 32, 16)
    got = {r.source_name: r for r in shares.collect()}
    assert got["none"].drawn_blocks == 0 and abs(got["a"].reached_share - 5 / 9) < 0.03 and abs(got["b"].reached_share - 3 / 9) < 0.03
    drawn = Counter((r.source_name, r.block) for r in mixed.collect())
    cap = {"a": 1, "b": 2, "c": 1}
    assert all(n <= cap[s] for (s, _), n in drawn.items()) and sum(drawn.values()) == sum(r.drawn_blocks for r in got.values())
    assert rows(mixed.drop("tokens")) == rows(mixing.mixture(df, targets, 32, 16)[0].drop("tokens"))
    everything = {r.doc_id: list(r.tokens) for r in tokenised(df, ["doc_id"], as_list=True).collect()}
    found = mixed.collect()
    for r in found:  # each block leads back to its documents
        assert [t for d in r.docs for t in everything[d.doc_id][d.start : d.start + d.n]] == list(r.tokens) and r.n == len(r.tokens)
    sizes = Counter()
    for r in found:
        sizes[r.source_name] += r.n
    assert {s: r.drawn_tokens for s, r in got.items() if r.drawn_blocks} == sizes
    assert sorted((r.shard, r.position) for r in found) == sorted({(r.shard, r.position) for r in found}) and max(r.position for r in found) < 16
    assert got["a"].used_share == 1.0 or got["b"].passes == 2
    assert mixing.mixture(df, targets, 32, 16, total_blocks=10_000)[1].filter("source_name = 'b'").first().drawn_blocks == 2 * got["b"].source_blocks
    assert mixing.mixture(df.limit(0), targets)[0].count() == 0


RESIDUE = {
    "script": ["Please enable JavaScript to view this page.", "Terms - Help Your browser does not support scripts; update it.", "Bitte JavaScript einschalten, um die Galerie zu sehen.", "THIS VIEWER NEEDS JAVASCRIPT."],
    "error": ["Error 404: nothing here", "HTTP 503", "The listing could not be loaded.", '{"error":{"code":500}}', "Acceso denegado.", "Bad gateway.", "Status: 500, the page was not found. Reference ab12cd34."],
    "placeholder": ["Owned by {{ owner }} since May.", "The price is ${price} now.", "It has [INSERT TITLE] on it.", "Your description goes here.", "sold NaN pieces", "TODO: write this", "about XXXX pieces"],
    "filler": ["lorem ipsum dolor sit amet", "asdf qwer asdf zxcv", "text text text text"],
}
CONTENT = ["A 404 from the gateway does not mean that the picture is lost.", 'The piece "Page not found" was sold for 3 ETH.', "The mint page needs no JavaScript, which is why it is fast.", "The guide explains how a template such as {{name}} is filled in.", "The trait named Lorem is worn by 3 figures.", "Holders can claim a piece until block 22: see the list.", "", None, "   ", "Wallet apps replace {id} in the token URI with the number."]


def test_residue(spark):
    data = [t for texts in RESIDUE.values() for t in texts] + CONTENT
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(data)], "doc_id long, text string, source string").withColumn("kind", F.lit("clash"))
    found = {r.doc_id: r.kinds for r in residue.residue(df).collect()}
    expected = [k for k, texts in RESIDUE.items() for _ in texts]
    assert {i: k for i, k in enumerate(expected) if k not in found.get(i, [])} == {}
    assert set(found) == set(range(len(expected)))
    assert residue.clean(df).count() == len(CONTENT) and "kind" in residue.clean(df).columns
    assert residue.residue(df.limit(0)).count() == 0
    mixed = spark.createDataFrame([(1, "A fine text about boats.\nError 404: gone", None)], "doc_id long, text string, source string")
    assert rows(residue.residue(mixed), "doc_id") == [(1,)]


def test_frame_of_a_host_is_no_residue(spark):
    body = lambda i: f"Boat {i} went out." + ("\nThis site requires JavaScript." if i < 200 else "")
    df = spark.createDataFrame([(i, body(i), "framed" if i < 200 else "plain") for i in range(400)] + [(900, "Boat.\nThis site requires JavaScript.", "plain")], "doc_id long, text string, source string")
    assert rows(residue.residue(df), "doc_id") == [(900,)]


def test_residue_beside_words_of_mention(spark):
    left = ["This piece is titled {{title}} by ${artist}.", "Error 500: the template could not be rendered.", "The template could not be loaded.", "Flagged by {{moderator}}.", "The motto of {{team}} is new.", "Use a field such as {{name}} for {{owner}} of this.", "One buyer moved the NaN set to storage.", "The undefined set was sold.", "Royalties are set to NaN percent."]
    spoken = ["Templates hold fields such as {{title}} and ${artist}.", "The field named ${owner} holds the address.", "Scripts read ${seed} from a hash.", "A NaN carved in stone.", "They show messages such as: something went wrong.", "In drafts, {{title}} stood for the title.", "Its motto: lorem ipsum dolor sit amet.", "The field is set to null if unknown.", "A null set has measure zero."]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(left + spoken)], "doc_id long, text string, source string")
    assert rows(residue.residue(df), "doc_id") == [(i,) for i in range(len(left))]


def test_residue_of_common_messages(spark):
    script = ["You need to enable JavaScript to run this app.", "Enable JavaScript and cookies to continue", "JavaScript is required.", "Please enable JavaScript.", "JavaScript must be enabled to view this page."]
    error = ["404 Not Found", "HTTP 404 Not Found", "HTTP/1.1 403 Forbidden", "403 Forbidden", "503 Service Unavailable", "504 Gateway Time-out", "Harbour | 410 Gone"]
    placeholder = ["Your text here", "Add description here", "By {{ collection.metadata.description | default('none given by its owner') }} here.", "By ${collection.owner.profile.display_name.in_full} here.", "By [[the description of the collection in two sentences]] here."]
    content = ["A 404 Not Found reply means that the picture is gone.", "JavaScript is required reading for developers.", "You do not need to enable JavaScript.", "Write your name here and win.", "The fee was 403 forbidden fruits.", "The site no longer requires JavaScript.", "View image here."]
    texts = script + error + placeholder
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts + content)], "doc_id long, text string, source string")
    found = {texts[r.doc_id] if r.doc_id < len(texts) else content[r.doc_id - len(texts)]: r.kinds for r in residue.residue(df).collect()}
    assert found == {t: [k] for k, of in (("script", script), ("error", error), ("placeholder", placeholder)) for t in of}


@pytest.mark.parametrize("left, spoken, least", [(LEFT, SPOKEN, 0.95), (LEFT_UNSEEN, SPOKEN_UNSEEN, 0.8)])
def test_residue_of_sentences_that_no_generator_made(spark, left, spoken, least):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(left + spoken)], "doc_id long, text string, source string")
    found = [r.doc_id for r in residue.residue(df).collect()]
    right = sum(i < len(left) for i in found)
    assert right / len(left) >= least and right / len(found) >= max(0.9, least)


@pytest.mark.parametrize("n", [60, 600])
def test_copies_of_an_error_page_are_residue_at_any_size(spark, n):
    page = lambda i: f"# Tide {i}\nThe page could not be loaded.\nRequest ab{i:06d}cd.\nGo back to the harbour."
    texts = [(i, page(i) if i % 3 == 0 else f"Boat {i} went out.\nThis site requires JavaScript.", "s") for i in range(n)]
    bare = [(n + i, "Error 500: nothing here." if i % 3 == 0 else f"Boat {i} went out.", "t") for i in range(n)]
    df = spark.createDataFrame(texts + bare, "doc_id long, text string, source string")
    found = {r.doc_id for r in residue.residue(df).collect()}
    framed = set() if n == 600 else {i for i, t, _ in texts if "JavaScript" in t}
    assert found - framed == {i for i in range(2 * n) if (i if i < n else i - n) % 3 == 0}
    assert not found & {i for i, _, _ in bare if (i - n) % 3}


def test_very_long_text_without_breaks(spark):
    df = spark.createDataFrame([(1, "word " * 200_000, None), (2, "x" * 300_000, "s")], "doc_id long, text string, source string")
    assert residue.residue(df).count() <= 1
