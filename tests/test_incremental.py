import datetime as dt

import pytest

from holdfast.operators import incremental as N
from tests.conftest import rows

LISTING = "bucket string, key string, size bigint, etag string, class string, modified string, listed_at timestamp"
LOG = "log_seq bigint, s3_key string, record_id string, etag string, status string, attempts int, updated_at string"


def at(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=n)


@pytest.fixture
def listing(spark):
    data = [
        ("b", "new", 1, '"e1"', None, None, at(0)), ("b", "failed", 1, "e", None, None, at(0)), ("b", "same", 1, '"e"', None, None, at(0)), ("b", "changed", 1, "e2", None, None, at(0)),
        ("b", "noetag", 1, None, None, None, at(0)), ("b", "ledgerless", 1, "e", None, None, at(0)), ("b", "twice", 1, "old", None, None, at(0)), ("b", "twice", 1, "now", None, None, at(5)),
        ("b", "twice", 1, "now", None, None, at(5)), (None, None, None, None, None, None, None), ("b", "skipped", 1, "e", None, None, at(0)), ("b", "recovered", 1, "e", None, None, at(0)), ("b", "quote", 1, "", None, None, at(0)),
    ]
    return spark.createDataFrame(data, LISTING)


@pytest.fixture
def log(spark):
    data = [
        (1, "failed", None, None, "failed", 1, "2026-01-01T00:00:00Z"), (2, "same", "r", "e", "done", 1, "2026-01-01T00:00:00+00:00"), (3, "changed", "r", "e1", "done", 1, "2026-01-01T00:00:00Z"),
        (4, "noetag", "r", "x", "done", 1, "2026-01-01T00:00:00Z"), (5, "ledgerless", "r", None, "done", 1, "2026-01-01T00:00:00Z"), (6, "twice", "r", "now", "done", 1, "2026-01-01T00:00:00Z"),
        (7, "skipped", None, "e", "skipped", 1, "2026-01-01T00:00:00Z"), (9, "recovered", "r", "e", "done", 2, "2026-01-01T00:00:00Z"), (10, "recovered", None, None, "failed", 1, "2026-01-01T00:00:00+00:00"),
        (8, "recovered", None, None, "failed", 1, "2025-12-31T23:59:59Z"), (8, "recovered", None, None, "failed", 1, "2025-12-31T23:59:59Z"), (11, None, None, None, "done", 1, None), (12, "quote", None, '"q"', "done", None, "no time"),
    ]
    return spark.createDataFrame(data, LOG)


def test_pending(listing, log):
    assert [r[0] for r in rows(N.pending_keys(listing, log))] == ["changed", "failed", "new"]


def test_order_and_partitions_do_not_matter(listing, log):
    want = rows(N.pending_keys(listing, log))
    assert rows(N.pending_keys(listing.orderBy("size").repartition(7), log.repartition(5))) == want


def test_empty(spark, listing, log):
    none = spark.createDataFrame([], LISTING)
    assert rows(N.pending_keys(none, log)) == []
    assert len(rows(N.pending_keys(listing, spark.createDataFrame([], LOG)))) == 10  # all keys of the listing


def test_run_commits_once(spark, tmp_path, listing):
    run = N.IncrementalRun(spark, str(tmp_path))
    work = lambda todo: todo.selectExpr("item_key", "upper(item_key) AS made", "if(item_key = 'failed', 'failed', 'done') AS status")
    first = run.run(listing, work)
    assert run.committed() == [first]
    # only the failed one is left, and nothing once it succeeds
    second = run.run(listing, lambda t: t.selectExpr("item_key", "item_key AS made"))
    assert second.split("-")[1] == "1"
    assert run.run(listing, work) is None


def test_failure_before_commit_repeats_the_same_batch(spark, tmp_path, listing):
    run = N.IncrementalRun(spark, str(tmp_path))

    def broken(todo):
        raise RuntimeError("lost")

    name, _ = run.plan(listing)
    with pytest.raises(RuntimeError):
        run.run(listing, broken)
    # output written, manifest not: the marker is what counts
    spark.range(1).selectExpr("'x' AS item_key").write.parquet(f"{tmp_path}/batches/{name}")
    (tmp_path / "manifest" / name).mkdir(parents=True)
    assert run.committed() == []
    assert run.plan(listing)[0] == name
    assert run.run(listing, lambda t: t.select("item_key")) == name
    assert run.committed() == [name]
    assert spark.read.parquet(f"{tmp_path}/batches/{name}").count() == 10


def test_changed_object_comes_again(spark, tmp_path, listing):
    run = N.IncrementalRun(spark, str(tmp_path))
    run.run(listing, lambda t: t.select("item_key"))
    newer = listing.union(spark.createDataFrame([("b", "same", 1, "other", None, None, at(99))], LISTING))
    assert [r[0] for r in rows(run.plan(newer)[1])] == ["same"]


def test_a_listing_that_grows_during_the_run_loses_nothing(spark, tmp_path):
    src, seen = str(tmp_path / "listing"), []
    row = lambda k, n=0: spark.createDataFrame([("b", k, 1, f"e-{k}", None, None, at(n))], LISTING)
    row("early").write.parquet(src)
    listing = spark.read.schema(LISTING).parquet(src)

    def work(todo):
        late = f"late{len(seen)}"
        row(late).write.mode("append").parquet(src)  # a page that arrives meanwhile
        seen.append(sorted(r["item_key"] for r in todo.collect()))
        return todo.select("item_key")

    run = N.IncrementalRun(spark, str(tmp_path / "runs"))
    for _ in range(3):
        spark.catalog.refreshByPath(src)
        run.run(spark.read.schema(LISTING).parquet(src), work)
    assert seen == [["early"], ["late0"], ["late1"]]
    assert {r["item_key"]: r["status"] for r in run.manifest().collect()} == {"early": "done", "late0": "done", "late1": "done"}


def test_size_is_in_the_manifest(spark, tmp_path):
    run = N.IncrementalRun(spark, str(tmp_path))
    row = lambda size, etag: spark.createDataFrame([("b", "k", size, etag, None, None, at(0))], LISTING)
    run.run(row(1, None), lambda t: t.select("item_key"))
    assert rows(run.manifest()) == [("k", None, 1, "done")]
    assert rows(run.plan(row(1, "any"))[1]) == [] and rows(run.plan(row(None, None))[1]) == []
    assert [r[0] for r in rows(run.plan(row(2, None))[1])] == ["k"]


def test_compaction(spark, tmp_path):
    run = N.IncrementalRun(spark, str(tmp_path), compact_after=2)
    names = []
    for n in range(5):
        listing = spark.createDataFrame([("b", f"k{i}", 1, "e", None, None, at(0)) for i in range(n + 1)], LISTING)
        names.append(run.run(listing, lambda t: t.select("item_key")))
        assert run.run(listing, lambda t: t.select("item_key")) is None
        assert len(rows(run.manifest())) == n + 1 and len(run.committed()) <= 2
    assert [x[:6] for x in names] == [f"{n:06d}" for n in range(5)]
    # a folded folder without its marker isn't in force
    (tmp_path / "manifest" / "000009-all").mkdir()
    assert len(rows(run.manifest())) == 5
