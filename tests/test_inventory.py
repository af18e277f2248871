import datetime as dt

import pytest

from holdfast.operators import inventory as I
from holdfast.plans import reports
from tests.conftest import rows

SCHEMA = "bucket string, key string, size bigint, etag string, class string, modified string, listed_at timestamp"
T = dt.datetime(2026, 1, 1)


@pytest.fixture
def objects(spark):
    data = [
        ("a", "x/one.pdf", 10, '"e1"', None, "2010-01-01", T), ("a", "x/two.pdf", 10, "e1", "", "2011-01-01", T), ("b", "y/z/one.pdf", 10, "e1", "GLACIER", "x", T), ("b", "empty/", 0, "d4", None, None, T),
        ("b", "._n.pdf", 5, "e2", None, "2010", T), ("a", "x/two.pdf", 99, "e9", None, None, T - dt.timedelta(days=1)), ("a", "m.jpg", None, None, None, None, T), (None, None, None, None, None, None, None), ("b", "p.html", 7, "q-2", None, "2011-", T),
    ]
    return I.current_objects(spark.createDataFrame(data, SCHEMA))


def test_totals_leave_noise_aside(objects):
    assert I.corpus_totals(objects).first().asDict() == {"objects": 5, "bytes": 37, "documents": 3, "document_bytes": 30, "pdfs": 3, "pdf_bytes": 30, "noise_objects": 2, "noise_bytes": 5}


def test_duplicates(objects):
    assert rows(I.duplicate_totals(objects)) == [(1, 1, 2)]
    assert rows(I.listing_duplicates(objects)) == [("a", 1, 1)]
    assert rows(I.largest_groups(objects, members=2)) == [("e1", 3, 2, "a::x/one.pdf\na::x/two.pdf")]
    assert rows(I.name_size_collisions(objects)) == []


def test_dimensions_are_one_exchange(objects):
    plan = I.dimension_counts(objects)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") <= 2  # one for the current objects, one for the counts
    got = {(r["bucket"], r["dim"], r["value"]): (r["objects"], r["bytes"]) for r in I.dimension_counts(objects).collect()}
    assert got["a", "ext", ".pdf"] == (2, 20) and got["b", "class", "GLACIER"] == (1, 10) and got["a", "prefix", "x"] == (2, 20)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 50, 51])
def test_percentiles_by_nearest_rank(spark, n):
    sizes = [(i * 37) % 101 * 1000 + i for i in range(n)]
    o = spark.createDataFrame([("b", str(i), s, None, None, None, T) for i, s in enumerate(sizes)], SCHEMA)
    r = I.size_summary(o).first()
    ordered = sorted(sizes)
    for p in (50, 90, 99):
        assert r[f"p{p}"] == ordered[round(p / 100 * (n - 1))]
    assert (r["objects"], r["bytes"], r["mean"], r["min"], r["max"]) == (n, sum(sizes), sum(sizes) // n, ordered[0], ordered[-1])


def test_noise_changes_no_totals(spark, objects):
    more = objects.union(spark.createDataFrame([("a", "n/.DS_Store", 6, "e1", None, None)], objects.schema))
    pick = ["objects", "bytes", "documents", "pdfs"]
    assert I.corpus_totals(more).select(pick).first() == I.corpus_totals(objects).select(pick).first()
    assert rows(I.duplicate_totals(more)) == rows(I.duplicate_totals(objects))


def test_sample_scope_and_empty(spark, objects):
    assert [r[1:] for r in rows(I.stride_sample(objects, 3))][0] == ("a", "m.jpg")
    reg = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "name string, in_scope boolean")
    names = lambda **k: [r["name"] for r in I.select_scope(reg, **k).orderBy("name").collect()]
    assert names() == ["a"] and names(undecided=True) == ["a", "b"] and names(excluded=True) == ["a", "c"] and names(only=["c"]) == ["c"]
    with pytest.raises(ValueError):
        names(only=["nope"])
    none = objects.where("false")
    assert I.corpus_totals(none).first()["objects"] == 0 and rows(I.size_summary(none)) == [] and rows(I.stride_sample(none)) == []
    assert rows(I.unknown_buckets(objects, reg.where("name = 'a'"))) == [("b", 4)]


def test_report(objects):
    doc = reports.summary(objects)
    text = reports.markdown(doc)
    assert "- PDFs: 3 (30 B)" in text and "e1" in text
    assert reports.digest(doc)[0].endswith("PARTIAL")
    assert rows(reports.year_chart(objects, 10)) == [("2010", 2, "#" * 10), ("2011", 2, "#" * 10)]
    assert sum(r["share"] for r in reports.type_shares(objects).collect()) == pytest.approx(1, abs=1e-5)
    assert reports.human(1536) == "1.5 KB"


def test_listing_summary(spark, objects):
    reg = spark.createDataFrame([("a", "eu"), ("z", "us"), (None, "x")], "name string, region string")
    got = {r["bucket"]: r for r in I.listing_summary(objects, reg).collect()}
    n = objects.groupBy("bucket").count().collect()
    assert {b: r["objects"] for b, r in got.items()} == {r["bucket"]: r["count"] for r in n} | {"z": 0}
    assert got["z"]["by_ext"] == "" and got["a"]["region"] == "eu" and got["b"]["region"] is None
    for r in got.values():
        for dim in ("ext", "ctype", "class", "material", "prefix"):
            assert sum(int(x.rsplit("=", 1)[1].split("/")[0]) for x in r[f"by_{dim}"].split("\n") if x) == r["objects"]
    years = [x[:4] for x in got["b"]["by_year"].split("\n")]
    assert years == sorted(years)
    assert rows(I.listing_summary(objects.where("false"))) == []
    text = "\n".join(reports.console(objects))
    assert "Objects: " in text and "Size distribution" in text and "By content type" in text and "Duplication" in text


def test_empty_listings(spark, objects):
    reg = spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "name string")
    assert rows(I.empty_listings(objects, reg)) == [("z",)]
    with pytest.raises(Exception, match="every listing is empty"):
        I.empty_listings(objects.where("false"), reg).collect()


def test_largest_groups_of_a_listing(spark):
    data = [("a", f"k{i}", 5, "e1", None, None) for i in range(7)] + [("a", "x", 5, "e2", None, None), ("b", "y", 5, "e1", None, None), ("a", "m1", 5, "p-2", None, None), ("a", "m2", 5, "p-2", None, None)]
    o = spark.createDataFrame(data, "bucket string, key string, size bigint, etag string, class string, modified string")
    assert rows(I.largest_listing_groups(o)) == [("a", "e1", 7, "k0\nk1\nk2\nk3\nk4")]
