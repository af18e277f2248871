import random

import numpy as np

from holdfast.llm import neardup as D
from tests.conftest import rows

SCHEMA = "id string, body_text string, capture_date string, node int"


def brute(data, k, threshold, least):
    sets = {}
    for i, t, *_ in data:
        w = (t or "").lower().split()
        if i is not None and len(w) >= least:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return sorted((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))


def make(seed=1, docs=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    data = []
    for n in range(docs):
        body = [r.choice(words) for _ in range(r.randrange(50, 400))]
        data.append((f"d{n:04d}", " ".join(body), "2020", 1))
        if n % 4 == 0:
            for c in range(2):
                other = list(body)
                for _ in range(len(other) // 40):
                    other[r.randrange(len(other))] = r.choice(words)
                if c:
                    del other[5:8]
                data.append((f"d{n:04d}x{c}", "  ".join(other).upper(), "2020", 1))
        if n % 10 == 0:
            data.append((f"d{n:04d}y", "\n".join(body), "2020", 1))
    return data


def test_pairs_equal_brute_force(spark):
    data = make()
    df = spark.createDataFrame(data + [data[0], (None, "x", None, None), ("null", None, None, None), ("short", "a b c", "2020", 1), ("empty", "", "2020", 1)], SCHEMA)
    want = brute(data, 3, 0.5, 50)
    got = [tuple(r) for r in rows(D.near_duplicate_pairs(df))]
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 80


def test_groups(spark):
    data = make(2, 40)
    g = {r["record_id"]: (r["group_id"], r["links"]) for r in D.NearDuplicates(spark.createDataFrame(data, SCHEMA)).groups().collect()}
    assert set(g) == {d[0] for d in data}
    assert g["d0000y"][0] == "d0000" and g["d0001"] == ("d0001", 0)


def test_groups_of_short_and_empty_texts(spark):
    data = [("a", "cover sheet", "2020", 1), ("b", "Cover  sheet", "2020", 1), ("c", "cover page", "2020", 1), ("d", "", "2020", 1), ("e", None, "2020", 1), (None, "cover sheet", "2020", 1)]
    dup = D.NearDuplicates(spark.createDataFrame(data, SCHEMA))
    assert rows(dup.groups()) == [("a", "a", 0), ("b", "a", 0), ("c", "c", 0), ("d", "d", 0), ("e", "d", 0)]
    assert rows(dup.all_pairs()) == []


def test_masses_of_copies_and_of_variants(spark):
    r = random.Random(5)
    body = [f"w{r.randrange(500)}" for _ in range(120)]
    data = [(f"c{i:03d}", " ".join(body), "2020", 1) for i in range(150)]
    for i in range(100):
        other = list(body)
        other[i] = "changed"
        data.append((f"v{i:03d}", " ".join(other), "2020", 1))
    dup = D.NearDuplicates(spark.createDataFrame(data, SCHEMA), k=3, threshold=0.5, min_words=50)
    assert {x["group_id"] for x in dup.groups().collect()} == {"c000"}
    pairs = {tuple(x) for x in dup.all_pairs(max_copies=64).collect()}
    assert {("c000", f"c{i:03d}") for i in range(1, 150)} <= pairs and {("c000", f"v{i:03d}") for i in range(100)} <= pairs


def test_pairs_of_a_large_family(spark):
    r = random.Random(7)
    body = [f"w{r.randrange(500)}" for _ in range(120)]
    data = []
    for i in range(300):
        other = list(body)
        for at in r.sample(range(120), 3):
            other[at] = f"x{r.randrange(500)}"
        data.append((f"v{i:03d}", " ".join(other), "2020", 1))
    want = brute(data, 3, 0.5, 50)
    got = {tuple(x) for x in rows(D.near_duplicate_pairs(spark.createDataFrame(data, SCHEMA)))}
    assert got <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 40_000


def test_alignment():
    a = np.arange(100, dtype=np.uint64)
    assert D.banded_alignment(a, a) == 1.0
    assert D.banded_alignment(a, np.concatenate([a[:50], a[60:]])) == 0.9
    assert D.banded_alignment(np.concatenate([a[50:], a[:50]]), a) == 0.5
    assert D.banded_alignment(a[:0], a[:0]) == 1.0
    h = D.kmers(np.array([1, 1, 1, 1, 2], np.uint64), 2)
    assert len(np.unique(h)) == 2 and len(np.unique(D.occurrence_labelled(h))) == 4


def test_order_matters_to_sketches():
    h = D._mix(np.arange(400, dtype=np.uint64))
    same = lambda x: len(np.intersect1d(D.order_min_hash(h), D.order_min_hash(x)))
    assert same(h) == len(np.unique(D.order_min_hash(h))) > 30
    assert same(h[::-1].copy()) == 0
    assert same(np.delete(h, 7)) > 0.8 * same(h)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(D.near_duplicate_pairs(df)) == [] and rows(D.NearDuplicates(df).groups()) == []


def test_moved_sentences_are_found(spark):
    r = random.Random(5)
    data = []
    for n in range(30):
        body = [" ".join(f"w{r.randrange(3000)}" for _ in range(22)) for _ in range(17)]
        data.append((f"m{n:02d}a", ". ".join(body), "2020", 1))
        r.shuffle(body)
        data.append((f"m{n:02d}b", ". ".join(body), "2020", 1))
    want = brute(data, 3, 0.5, 50)
    got = D.NearDuplicates(spark.createDataFrame(data, SCHEMA), k=3, threshold=0.5, min_words=50)
    assert len(want) == 30 and len(set(rows(got.all_pairs())) & set(want)) >= 27
    assert len(rows(got.aligned(0.9))) == 0


def test_joins_by_exchange_give_the_same(spark):
    data = make(4, 60) + [(f"c{i}", "one text that stands often " * 12, "2020", 1) for i in range(70)]
    df = spark.createDataFrame(data, SCHEMA)
    a, b = D.NearDuplicates(df, large=3), D.NearDuplicates(df, large=3, max_broadcast_rows=0)
    assert rows(a.groups()) == rows(b.groups()) and rows(a.all_pairs()) == rows(b.all_pairs()) and rows(a.members) == rows(b.members)
