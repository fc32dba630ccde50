import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinledger.functions import similarity as sim
from twinledger.functions import text
from twinledger.functions.documents import canonical, plain_number, plain_text


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("uri", "key"),
    [
        (None, ""), ("  ", ""), ("N/A", ""), ("data:image/png;base64,AA", ""), ("ipfs://ipfs/QmA/1.png?x=1", "ipfs:QmA/1.png"), ("IPFS://QmA//", "ipfs:QmA"), ("ar://AbC#f", "ar:AbC"),
        ("https://gate.example/ipfs/QmA/1?x", "ipfs:QmA/1"), ("https://x.arweave.net/" + "a" * 43 + "/1.png", "ar:" + "a" * 43 + "/1.png"), ("HTTPS://Host/A?Q=1/", "https://host/a?q=1"), ("ipfs://", ""),
    ],
)
def test_normalize_url(spark, uri, key):
    df = spark.createDataFrame([(uri,)], "u string")
    assert rows(df.select(text.normalize_url(F.col("u")))) == [(key,)]


@pytest.mark.parametrize(
    ("name", "short"),
    [(None, None), ("", ""), ("Cool Cats #12", "cool cats"), ("Cool  Cats (3) [4]", "cool cats"), ("Ape No. 7", "ape"), ("Ape nr 7 - 8", "ape"), ("ＡＢＣ 9", "abc"), ("#1", ""), ("1999", "1999"), ("A/B", "a/b")],
)
def test_normalize_name(spark, name, short):
    assert text.name_without_number(name) == short
    assert rows(spark.createDataFrame([(name,)], "n string").select(text.normalize_name(F.col("n")))) == [(short,)]


def test_usable_names_and_token_order(spark):
    df = spark.createDataFrame([(n,) for n in ["ok", " None ", "7", "77", "", None, "n.a.", "--"]], "n string")
    assert [r[0] for r in rows(df.select(text.usable_name(F.col("n"))))] == [True, False, False, True, False, False, False, False]
    ids = ["10", "9", "007", "abc", "115792089237316195423570985008687907853269984665640564039457584007913129639935"]
    ordered = spark.createDataFrame([(i,) for i in ids], "t string").orderBy(text.token_order(F.col("t")))
    assert [r[0] for r in rows(ordered)] == ["007", "9", "10", ids[4], "abc"]


def test_ids_addresses_and_encodings(spark):
    df = spark.createDataFrame([("0xff", "x/{id}.json", "255"), (None, None, None), ("zz", "y", "a")], "h string, u string, t string")
    assert rows(df.select(text.hex_to_decimal(F.col("h")), text.fill_token_id(F.col("u"), F.col("t")))) == [("255", "x/" + "0" * 62 + "ff.json"), (None, None), (None, "y")]
    key = text.base58_encode(bytes(range(32)))
    assert text.base58_decode(key) == bytes(range(32)) and text.base58_decode("0") is None
    made = spark.createDataFrame([("Solana", key), ("base", "0x" + "aB" * 20), ("base", key), ("solana", "short"), ("base", None)], "c string, a string")
    assert [r[0] for r in rows(made.select(text.valid_address(F.col("c"), F.col("a"))))] == [True, True, False, False, None]
    word = lambda n: format(n, "064x")
    data = "0x" + word(32) + word(5) + b"hello".hex().ljust(64, "0")
    assert rows(spark.createDataFrame([(data,), ("0x12",), (None,)], "d string").select(text.abi_string(F.col("d")))) == [("hello",), (None,), (None,)]


def test_inline_documents_and_pictures(spark):
    df = spark.createDataFrame([('data:application/json;base64,eyJpbWFnZSI6IngifQ==',), ("data:application/json,%7B%22image_url%22%3A%22y%22%7D",), ("https://a",), (None,)], "u string")
    found = df.select(text.inline_json(F.col("u")).alias("j")).select("j", text.image_of(F.col("j")))
    assert rows(found) == [('{"image":"x"}', "x"), ('{"image_url":"y"}', "y"), (None, None), (None, None)]


@pytest.mark.parametrize(("written", "plain"), [("1.0", "1"), ("9007199254740993.0", "9007199254740993"), ("12345678901234567890.5000", "12345678901234567890.5"), ("1.23456789012345678905e19", "12345678901234567890.5"), ("-0.0", "0"), ("1e70", "1e70"), ("5e-3", "0.005"), ("-12e1", "-120"), ("1.5e-80", "1.5e-80")])
def test_plain_number(written, plain):
    assert plain_number(written) == plain


def test_canonical_documents():
    assert canonical('{"b":1.0,"A":" X  y "}') == '{"a":"x y","b":1}'
    assert canonical('{"a":1,"a":2}') is None
    assert canonical('{"Name":1,"name":2}') is None
    assert canonical("{}") is None and canonical("") is None and canonical(None) is None and canonical("3") is None and canonical('{"a":NaN}') is None
    assert canonical('{"a":"' + "x" * 70_000 + '"}') is None
    one, two = ('{"attributes":[{"trait_type":"%s","value":1},{"trait_type":"%s","value":2}]}' % p for p in (("a", "b"), ("b", "a")))
    assert canonical(one) != canonical(two)
    assert canonical('{"attributes":[{"trait_type":"b","value":2},{"value":1.0,"trait_type":"A"}]}') == '{"attributes":[{"trait_type":"a","value":1},{"trait_type":"b","value":2}]}'
    assert canonical('{"B":1.0,"a":" X "}', False) == '{"B":1.0,"a":" X "}'
    assert canonical("[" * 50_000) is None
    assert plain_text("ΟΔΟΣ  Ａ") == "οδος a"


def test_jaro_winkler_known_values():
    for a, b, s in [("collection", "collectiom", 0.96), ("MARTHA", "MARHTA", 0.9611), ("dixon", "dicksonx", 0.8133), ("café", "cafe", 0.8833), ("", "", 1.0), ("a", "", 0.0), ("ab", "cd", 0.0)]:
        assert abs(sim.jaro_winkler(a, b) - s) < 1e-4


def test_least_common_is_lossless():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(1, 8))) for _ in range(2))
        common = sum(min(a.count(c), b.count(c)) for c in set(a))
        for t in (0.5, 0.8, 0.95):
            if sim.jaro_winkler(a, b) >= t:
                assert common >= sim.least_common(len(a), len(b), t)


def test_bm25_of_equal_and_disjoint_documents():
    assert abs(sim.bm25_cosine({"a": 2, "b": 1}, {"a": 2, "b": 1}) - 1) < 1e-12
    assert sim.bm25_cosine({"a": 1}, {"b": 1}) == 0 == sim.bm25_cosine({}, {})


def test_very_long_texts(spark):
    texts = [" " * 300_000 + "x", "/" * 300_000 + "x", "ipfs://" + "/" * 300_000, "#" * 100_000 + " 1", "x" + " " * 300_000 + "1", "9" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "u string")
    found = rows(df.select(text.normalize_url(F.col("u")), text.normalize_name(F.col("u")), text.usable_name(F.col("u")), text.plain_decimal(F.col("u"))))
    assert [r[0][:3] for r in found] == ["x", "///", "", "###", "x  ", "999"] and found[4][1] == "x"


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutations_and_back(n):
    from twinledger.functions.permutations import permuted, unpermuted

    seen = {tuple(permuted(np.arange(n), np.full(n, n), np.full(n, k))) for k in range(4)}
    assert all(sorted(p) == list(range(n)) for p in seen) and (n < 64 or len(seen) == 4)
    at, size, key = np.arange(n), np.full(n, n), np.full(n, 3)
    assert (unpermuted(permuted(at, size, key), size, key) == at).all()


def test_picture_suffixes(spark):
    from twinledger.functions.text import picture_suffix

    data = [("image/png; x", "a.gif", None), (None, "https://h/A.JPEG?x=.png", b""), (None, "h/a.tif", None), ("text/html", None, b"\x89PNG\r\n\x1a\nrest"), (None, "", b"RIFF1234WEBPx"), (None, None, b"RIFF1234WAVE"), (None, None, b" <SVG"), (None, None, b"GIF88a"), (None, None, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "i int, m string, u string, h binary")
    found = [r[0] for r in df.orderBy("i").select(picture_suffix(F.col("m"), F.col("u"), F.col("h"))).collect()]
    assert found == [".png", ".jpg", ".tiff", ".png", ".webp", None, ".svg", None, None]
