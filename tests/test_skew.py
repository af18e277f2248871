from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from holdfast.operators import skew as K
from tests.conftest import rows

C = "batch_id bigint, etag string, copies int, keys array<string>"
L = "bucket string, key string, size bigint, etag string"


def test_totals(spark):
    c = spark.createDataFrame(
        [(1, '"a"', 2, ["x", "y"]), (1, "a", 2, ["x", "y"]), (2, "a", 3, ["x", None]), (3, None, 4, ["z"]), (4, "b", None, None), (None, "b", 9, ["q"]), (5, "c", 1, [])], C
    )
    assert rows(K.totals_per_etag(c)) == sorted([("a", 2, 5, 2), (None, 1, 4, 1), ("b", 1, 0, 0), ("c", 1, 1, 0)], key=repr)
    assert rows(K.heavy_etags(c, 0.4)) == [("a",)]
    assert rows(K.totals_per_etag(spark.createDataFrame([], C))) == [] == rows(K.heavy_etags(spark.createDataFrame([], C)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from(["a", '"a"', "b", None])), max_size=12), st.lists(st.tuples(st.sampled_from(["a", '"b"', "c", None]), st.one_of(st.none(), st.integers(0, 9))), max_size=8))
def test_join_equals_plain_join(spark, batches, objects):
    c = spark.createDataFrame([(b, e, 1, ["k"]) for b, e in batches], C)
    o = spark.createDataFrame([("b", str(i), s, e) for i, (e, s) in enumerate(objects)], L)
    strip = lambda e: e.strip('"') if e else None
    left = {(b, strip(e)) for b, e in batches if e}
    want = {}
    for _, e in left:
        for f, s in objects:
            if strip(f) == e:
                n, t = want.get(e, (0, 0))
                want[e] = n + 1, t + (s or 0)
    got = {r["etag"]: (r["pairs"], int(r["pair_bytes"])) for r in K.joined_totals(c, o).collect()}
    assert got == want


def test_hot_key_is_one_row_after_the_partial_aggregate(spark):
    c = spark.range(20_000).selectExpr("id AS batch_id", "if(id % 10 < 9, 'hot', concat('e', id)) AS etag", "1 AS copies", "array(concat('k', id)) AS keys")
    top = K.totals_per_etag(c).orderBy("batches", ascending=False).first()
    assert (top["etag"], top["batches"], top["distinct_keys"]) == ("hot", 18_000, 18_000)
