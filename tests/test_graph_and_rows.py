import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators.components import connected_components
from holdfast.operators.rows import balanced, join_counted, one_per_key
from tests.conftest import rows


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


def test_components(spark):
    random.seed(3)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("hub", f"leaf{i}") for i in range(200)] + [(None, "x"), ("y", "y"), ("a", "b"), ("b", "a")]
    edges += [(f"r{random.randrange(60)}", f"r{random.randrange(60)}") for _ in range(40)]
    got = rows(connected_components(spark.createDataFrame(edges, "src string, dst string")))
    assert got == sorted(brute(edges), key=repr)
    assert rows(connected_components(spark.createDataFrame([], "src string, dst string"))) == []


def test_one_per_key(spark):
    data = [("a", "1", "old"), ("a", "2", "new"), ("b", None, "x"), ("b", None, "x"), (None, "1", "y"), ("c", "1", "z")]
    df = spark.createDataFrame(data, "id string, at string, v string")
    for limit in (100, 0):
        assert rows(one_per_key(df, "id", "at", limit)) == [("a", "2", "new"), ("b", None, "x"), ("c", "1", "z")]
    assert rows(one_per_key(df.where("false"), "id", "at")) == []


def test_balanced(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(p)
    one = spark.read.parquet(p)
    assert balanced(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows(balanced(one)) == rows(one)
    assert balanced(spark.range(0, 100, 1, 16)).rdd.getNumPartitions() == 16
    grouped = one.groupBy("id").count()
    assert balanced(grouped) is grouped and rows(balanced(one.where("false"))) == []


@pytest.mark.parametrize("most,hot", [(100, 3), (1, 3), (1, 50), (0, 3)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_counted(spark, most, hot, how):
    big = spark.createDataFrame([("h", i) for i in range(20)] + [("a", 1), ("a", 2), ("b", 1), (None, 7), ("only", 3)], "k string, v int")
    small = big.where("k IN ('h', 'a', 'b')").groupBy("k").agg(F.count("*").alias("n"))
    want = rows(big.join(small, "k", how))
    got = join_counted(big, small, "k", "n", how, most, hot)
    assert rows(got.select("k", "v", "n")) == want
    assert rows(join_counted(big.where("false"), small.where("false"), "k", "n", how, most, hot)) == []
