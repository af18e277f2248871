import random
from collections import Counter

import pytest

from holdfast.llm import mixing as M
from holdfast.llm import packing as P
from holdfast.llm import tokens as T
from tests.conftest import rows

SCHEMA = "doc_id bigint, text string, source string, tokens int, shard int"


def documents(spark, n=400, seed=1):
    r = random.Random(seed)
    data = [(i, " ".join(r.choice(["river", "stone", "and", "walked", "antidisestablishment", "é"]) for _ in range(r.randrange(1, 300))), r.choice(["a", "a", "a", "b", "c", None]), 1, 1) for i in range(n)]
    data += [(100_000 + i, data[0][1], "b", 1, 1) for i in range(5)] + [(200_000, None, "a", 1, 1), (200_001, "", "a", 1, 1), (None, "x", "a", 1, 1), (200_002, "word " * 5000, "c", 1, 1)]
    return spark.createDataFrame(data, SCHEMA)


def test_counts_are_exact():
    c = T.counter(T.VOCABULARY)
    for t in ("", "it's  a\n\n test\t é 日本語  x1y2!!  ", "a  ", "\n \n", "don't" * 30):
        assert c.count(t) == len(c.encoding.encode_ordinary(t))
    assert c.count(None) == 0


def test_best_fit():
    assert [sorted(b) for b in P.best_fit([(6, "a", 0, 0), (5, "b", 0, 0), (4, "c", 0, 0), (5, "d", 0, 0)], 10)] == [[0, 2], [1, 3]]
    # items of a cluster never meet, nor do those of a source where asked
    assert len(P.best_fit([(1, "a", 0, 1), (1, "b", 0, 1)], 10)) == 2
    assert len(P.best_fit([(1, "a", 1, 0), (1, "b", 1, 0)], 10)) == 1
    assert len(P.best_fit([(1, "a", 1, 0), (1, "b", 1, 0)], 10, separate_sources=True)) == 2
    assert P.best_fit([], 10) == []


@pytest.mark.parametrize("shard", [4_000_000, 9_000])
def test_packing_is_whole_and_tight(spark, shard):
    df = documents(spark)
    cap = 512
    got = P.pack(df, cap, shard_tokens=shard).collect()
    sizes = {r["doc_id"]: r["tokens"] for r in T.sized(df).collect()}
    spans = Counter()
    for r in got:
        assert r["token_end"] - r["token_start"] == r["tokens"]
        spans[r["doc_id"]] += r["tokens"]
    assert spans == sizes
    fill, texts = Counter(), {}
    key = {r["doc_id"]: r["text_key"] for r in T.sized(df).collect()}
    for r in got:
        fill[r["container_id"]] += r["tokens"]
        assert key[r["doc_id"]] not in texts.setdefault(r["container_id"], set())
        texts[r["container_id"]].add(key[r["doc_id"]])
    assert max(fill.values()) <= cap
    assert 1 - sum(fill.values()) / (len(fill) * cap) < 0.04
    assert all(n == 1 for d, n in Counter(r["doc_id"] for r in got).items() if sizes[d] <= cap)


def test_profiles_and_clusters(spark):
    df = documents(spark, 120)
    profiles = spark.createDataFrame([("small", 128), ("big", 1024), ("none", 0), (None, None)], "profile string, capacity_tokens int")
    got = P.pack_profiles(df, profiles)
    sizes = {r["doc_id"]: r["tokens"] for r in T.sized(df).collect()}
    for name, cap in (("small", 128), ("big", 1024)):
        assert rows(got.where(f"profile = '{name}'").drop("profile")) == rows(P.pack(df, cap))
        assert sum(r["tokens"] for r in got.where(f"profile = '{name}'").collect()) == sum(sizes.values())
    report = {r["profile"]: r for r in P.fill_by_profile(got, profiles).collect()}
    assert set(report) == {"small", "big"} and all(r["tokens"] == sum(sizes.values()) and 0 <= r["unused_share"] < 0.2 for r in report.values())
    none = P.fill_by_profile(P.pack_profiles(df.where("false"), profiles), profiles)
    assert rows(none) == [("big", 0, 0, 0, 0.0), ("small", 0, 0, 0, 0.0)]
    # near-duplicates named by the caller never meet
    one = spark.createDataFrame([(i, 7) for i in range(10)], "doc_id bigint, cluster int")
    at = {}
    for r in P.pack(df, 4096, clusters=one).where("doc_id < 10").collect():
        at.setdefault(r["container_id"], []).append(r["doc_id"])
    assert sorted(len(x) for x in at.values()) == [1] * 10


def test_packing_empty(spark):
    assert rows(P.fill_report(P.pack(documents(spark).where("false"), 100), 100)) == [(0, 0, 0, 0.0)]
    with pytest.raises(ValueError):
        P.pack(documents(spark), 0)


def test_weights():
    tokens, repeats = {"a": 900, "b": 100}, {"a": 1, "b": 2}
    w, x, total = M.weights_for(tokens, {"a": 0.5, "b": 0.5}, repeats)
    assert (w, x, total) == ({"a": 0.5, "b": 0.5}, 1.0, 400.0)
    w, x, total = M.weights_for(tokens, {"a": 0.5, "b": 0.5}, repeats, 1000)
    assert 0 < x < 1 and w["b"] * 1000 <= 200.001 and w["b"] == pytest.approx(0.2, abs=1e-3)
    assert M.entropy(M.tempered({"a": 0.9, "b": 0.1}, M.exponent_for_entropy({"a": 0.9, "b": 0.1}, 0.6))) == pytest.approx(0.6, abs=1e-6)
    assert M.weights_for({}, {"a": 1.0}, {"a": 1})[0] == {}


def test_mix(spark):
    df = documents(spark, 1500)
    goal = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 1), ("none", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = M.Mix(df, goal)
    plan = mix.plan().collect()
    limit = {"a": 2, "b": 3, "c": 1}
    key = {r["doc_id"]: r["text_key"] for r in T.sized(df).collect()}
    assert max(Counter(key[r["doc_id"]] for r in plan).values()) == 1  # copies count as one text
    assert all(1 <= r["uses"] <= limit[r["source"]] for r in plan)
    report = {r["source"]: r for r in mix.report().collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert report[s]["actual_share"] == pytest.approx(share, abs=0.01)
    assert report["none"]["tokens"] == 0
    assert rows(M.Mix(df.repartition(5), goal).plan()) == sorted(map(tuple, plan), key=repr)
    big = M.Mix(df, goal, total=1e9)
    assert all(r["uses"] == limit[r["source"]] for r in big.plan().collect())
    assert rows(M.Mix(df.where("false"), goal).plan()) == []
    # all tokens: limits bind, the exponent is bisected, texts are repeated
    small_b = spark.createDataFrame([("a", 0.3, 2), ("b", 0.6, 2), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    limit = {"a": 2, "b": 2, "c": 1}
    whole = M.Mix(df, small_b, total="all")
    used = whole.plan().collect()
    assert 0 < whole.exponent < 1 and max(r["uses"] for r in used) > 1 and all(r["uses"] <= limit[r["source"]] for r in used)
    assert sum(r["tokens"] * r["uses"] for r in used) == pytest.approx(whole.total, rel=0.01)
    tempered = M.Mix(df, goal, entropy_of_targets=True)
    got = {r["source"]: r for r in tempered.report().collect()}
    assert M.entropy(tempered.weights) == pytest.approx(M.entropy({"a": 0.5, "b": 0.3, "c": 0.2}), abs=1e-6)
    for s, w in tempered.weights.items():
        assert got[s]["actual_share"] == pytest.approx(w, abs=0.01)
    t = {r["source"]: r for r in M.temperature_weights(df, goal).collect()}
    assert sum(r["weight"] for r in t.values()) == pytest.approx(1)
