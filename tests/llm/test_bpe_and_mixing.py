import os
import random

import pytest

from specmill.llm import bpe
from specmill.llm.mixing import entropy, entropy_weights, mix, mixing_weights

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no tokenizer files")


@needs_vocabulary
def test_ids_are_those_of_the_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_vocabulary(bpe.VOCABULARY)
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [None, "", " ", "  x  \n y\t\t z  ", "½ ²x \x1c a", "it's we'll DON'T", "<|endoftext|>", "снег, 12 345 — ёж №5", "訪問者への注記", "a" * 3000]
    texts += ["".join(rng.choice("аб ve'\n漢１9,ก👍 ") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts.append("".join(rng.choice("абвгabc漢字") for _ in range(20_000)))
    encoder = bpe.Encoder(ranks)
    for _ in range(2):  # the second time from what it has kept
        offsets, ids = encoder.encode_batch(texts)
        for i, t in enumerate(texts):
            got = ids[offsets[i] : offsets[i + 1]].tolist()
            assert got == public.encode_ordinary(t or "")
            assert public.decode(got) == (t or "")


@needs_vocabulary
def test_pieces_split_as_whole_texts():
    regex = pytest.importorskip("regex")
    full, encoder, rng = regex.compile(bpe.PATTERN), bpe.Encoder(bpe.read_vocabulary(bpe.VOCABULARY)), random.Random(4)
    texts = ["\n  b", "a\n ", "a \n  \t b  ", " \n", "\u3000  x"] + ["".join(rng.choice("aб \n\t\u00a0,1'") for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    for t in texts:
        assert [w for p in encoder.cut(t) for w in encoder.split(p)] == full.findall(t), repr(t)


@needs_vocabulary
def test_two_vocabularies_in_one_session(spark):
    tiktoken = pytest.importorskip("tiktoken")
    other = bpe.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    rows = spark.createDataFrame([(1, "Насос подаёт воду. Pumps 12")], "id long, t string").coalesce(1)
    for path in (bpe.VOCABULARY, other, bpe.VOCABULARY):
        public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_vocabulary(path), special_tokens={})
        assert bpe.encode(rows, "t", ["id"], vocabulary=path).first()["ids"] == public.encode_ordinary("Насос подаёт воду. Pumps 12")
    assert 1 << bpe._PLACE > 1 << 31  # any position of a text that Arrow can hold


@needs_vocabulary
def test_operator(spark):
    rows = spark.createDataFrame([(1, "снег"), (2, None), (3, ""), (1, "снег")], "id long, ids string")
    got = bpe.encode(rows, "ids", ["id"]).collect()
    assert sorted((r["id"], len(r["ids"])) for r in got)[2:] == [(2, 0), (3, 0)]
    counts = bpe.encode(rows, "ids", ["id"], count_only=True).collect()
    assert {r["id"]: r["n_tokens"] for r in counts} == {r["id"]: len(r["ids"]) for r in got}
    assert bpe.encode(rows.where("false"), "ids", ["id"]).count() == 0


def test_weights():
    target, tokens, repeats = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, "b": 100}, {"a": 1, "b": 2, "c": 5}
    weights, exponents, size = mixing_weights(target, tokens, repeats)
    assert set(exponents.values()) == {1.0} and weights["a"] == pytest.approx(0.625) and size == pytest.approx(200 / 0.375)
    weights, exponents, size = mixing_weights(target, tokens, repeats, total=1000)
    assert 0 < exponents["b"] < 1 and weights["b"] * size == pytest.approx(200, rel=1e-3) and weights["a"] * size == pytest.approx(800, rel=1e-3)
    # what the limit takes from one source goes to the others in proportion to their targets
    weights, exponents, size = mixing_weights({"a": 0.4, "b": 0.4, "c": 0.2}, {"a": 10_000, "b": 50, "c": 10_000}, {"a": 2, "b": 2, "c": 2}, total=1000)
    assert exponents["b"] < 1 == exponents["a"] and weights["b"] == pytest.approx(0.1, rel=1e-3) and weights["a"] / weights["c"] == pytest.approx(2)
    weights, _, size = mixing_weights(target, tokens, repeats, total=10**9)
    assert size == pytest.approx(1200) and weights["b"] == pytest.approx(1 / 6)
    assert mixing_weights(target, {}, repeats) == ({}, {}, 0.0) == mixing_weights(target, {}, repeats, total=5)


def test_weights_of_an_entropy():
    tokens, free = {"a": 900, "b": 90, "c": 10}, {"a": 9, "b": 9, "c": 99}
    natural = entropy({s: n / 1000 for s, n in tokens.items()})
    weights, exponents, size = entropy_weights(tokens, free, 0.8)
    assert natural < 0.8 and entropy(weights) == pytest.approx(0.8, abs=1e-6) and 0 < exponents["a"] < 1 and size == pytest.approx(1000)
    weights, exponents, size = entropy_weights(tokens, {"a": 9, "b": 9, "c": 2}, 0.8)
    assert weights["c"] * size == pytest.approx(20, rel=1e-3) and natural < entropy(weights) < 0.8
    assert entropy_weights({}, {}, 1.0) == ({}, {}, 0.0)


def test_mix_keeps_limits_and_reaches_shares(spark):
    rows = [(i, "a", 10) for i in range(3000)] + [(10_000 + i, "b", 7) for i in range(200)] + [(20_000, None, 5), (20_001, "z", 5), (20_002, "a", 0), (20_003, "a", None)]
    records = spark.createDataFrame([(*r, "x") for r in rows], "id long, source string, n long, block string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("c", 0.1, 2)], "source string, target_share double, max_repeat int")
    uses, shares = mix(records, "id", "source", "n", targets, exact=True)
    per = {(r["source"], r["id"]): r["count"] for r in uses.groupBy("source", "id").count().collect()}
    assert max(v for (s, _), v in per.items() if s == "a") == 1 and max(v for (s, _), v in per.items() if s == "b") <= 3
    report = {r["source"]: r for r in shares.collect()}
    assert report["a"]["actual_share"] == pytest.approx(0.6, abs=0.01) and report["b"]["actual_share"] == pytest.approx(0.4, abs=0.01)
    assert report["c"]["actual_share"] == 0.0 and report["c"]["records"] == 0
    again, _ = mix(records.repartition(7), "id", "source", "n", targets, exact=True)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, uses.collect()))


def test_mix_of_the_size_of_the_corpus(spark):
    records = spark.createDataFrame([(i, "a", 10) for i in range(3000)] + [(10_000 + i, "b", 7) for i in range(200)], "id long, source string, n long")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 3), ("b", 0.1, 2), ("d", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeat int")
    uses, shares = mix(records, "id", "source", "n", targets)
    report = {r["source"]: r for r in shares.collect()}
    assert report["b"]["exponent"] < 1 and report["b"]["used_tokens"] == 3 * 1400 == report["b"]["most_repeats"] * 1400 and set(report) == {"a", "b", "d"}
    assert report["a"]["used_tokens"] + report["b"]["used_tokens"] == pytest.approx(31_400, abs=10)
    rows = uses.collect()
    orders = {b: [r["id"] for r in sorted(rows, key=lambda r: r["place"]) if r["block"] == b and r["source"] == "b"] for b in (1, 2, 3)}
    assert sorted(orders[1]) == sorted(orders[2]) == sorted(orders[3]) and orders[1] != orders[2] != orders[3]
    # the last block of a source is the start of its order
    partial, _ = mix(records, "id", "source", "n", targets, total=2000)
    got = [r for r in partial.collect() if r["source"] == "a"]
    everything, _ = mix(records, "id", "source", "n", targets, total=30_000 / 0.6)
    order = [r["id"] for r in sorted(everything.where("source = 'a' and block = 1").collect(), key=lambda r: r["place"])]
    assert len(got) == 120 and {r["id"] for r in got} == set(order[:120])
    assert mix(records.where("false"), "id", "source", "n", targets)[0].count() == 0
