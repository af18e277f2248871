import gzip
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.operators import ledger as L
from holdfast.sources import files
from holdfast.sources.paged import PagedListing, listing_actions, listing_totals, resumed_options
from holdfast.streaming import ledger as SL
from tests.conftest import rows


def log(spark, data):
    return spark.createDataFrame([(n, k, r, s, e, None, st, a, err, t) for n, (k, r, s, e, st, a, err, t) in enumerate(data)], schemas.LEDGER)


@pytest.fixture
def events(spark):
    return log(spark, [
        ("k1", None, None, None, "failed", 1, "x", "2026-01-01T00:00:00Z"), ("k1", "r1", "s", "e", "done", 2, None, "2026-01-02T00:00:00Z"), ("k2", "r2", "s", '"e"', "done", 1, None, "2026-01-01T12:00:00+00:00"),
        ("k3", "r3", "t", None, "done", 1, None, "2026-01-01T00:00:00Z"), ("k3", None, None, None, "failed", 2, "y", "2026-01-03T00:00:00Z"), (None, None, None, None, "done", 1, None, None),
    ])


def test_state(spark, events):
    s = L.state(events)
    assert rows(s.select("s3_key", "status", "record_id")) == [("k1", "done", "r1"), ("k2", "done", "r2"), ("k3", "failed", None)]
    assert rows(L.status_counts(s)) == [("done", 2), ("failed", 1)]
    assert rows(L.seen_texts(s)) == [("s", "r2", 2)]
    assert rows(L.failures(s)) == [("k3", 2, "y")]
    wanted = spark.createDataFrame([("k1", '"e"'), ("k2", "other"), ("k3", None)], "s3_key string, etag string")
    assert rows(L.done_keys(s, wanted)) == [("k1",)]
    assert rows(L.lookup(s, wanted.where("s3_key = 'k2'")).select("s3_key")) == [("k2",)]


def test_events(spark):
    items = spark.createDataFrame([("k", "r", "e" * 5000)], "s3_key string, record_id string, error string")
    f = L.event(items, "failed").first()
    assert len(f["error"]) == 2000 and f["record_id"] is None
    assert L.event(items, "done").first()["record_id"] == "r"
    with pytest.raises(ValueError):
        L.event(items, "lost")
    seq = spark.createDataFrame([(1, "k", "failed"), (2, "k", "failed"), (3, "k", "done")], "seq bigint, s3_key string, status string")
    for c in ("record_id", "text_sha256", "etag", "error", "updated_at"):
        seq = seq.withColumn(c, F.lit(None).cast("string"))
    u = L.upserted(seq.withColumn("byte_size", F.lit(1))).first()
    assert (u["status"], u["attempts"]) == ("done", 3)


def test_stream_equals_batch(spark, events, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(3).write.parquet(src)
    SL.maintain(SL.event_stream(spark, src, 1), target, str(tmp_path / "cp")).awaitTermination()
    events.where("s3_key = 'k3'").limit(1).selectExpr("99L AS log_seq", "s3_key", "'r9' AS record_id", "text_sha256", "etag", "byte_size", "'done' AS status", "3 AS attempts", "error", "'2026-02-01T00:00:00Z' AS updated_at").write.mode("append").parquet(src)
    SL.maintain(SL.event_stream(spark, src, 1), target, str(tmp_path / "cp")).awaitTermination()
    assert rows(SL.current(spark, target)) == rows(L.state(spark.read.schema(schemas.LEDGER).parquet(src)))


def test_windowed(spark, events):
    assert sum(r["events"] for r in SL.windowed_events(events.where("s3_key IS NOT NULL")).collect()) == 5


def test_listing_files(spark, tmp_path):
    row = lambda k, s: json.dumps({"Key": k, "Size": s, "ETag": '"e"', "Modified": "2020"})
    p = tmp_path / "bucket-x.jsonl.gz"
    p.write_bytes(gzip.compress((row("a", 1) + "\n\n").encode()) + gzip.compress((row("a", 1) + "\n" + row("b", 2) + "\n").encode()))
    assert rows(files.read_listing(spark, str(p)).select("bucket", "key", "size")) == [("bucket-x", "a", 1), ("bucket-x", "b", 2)]
    assert files.read_listing(spark, str(p), unique=False, partitions=2).count() == 3
    for n, (body, want) in enumerate([(f"[{row('a', 1)}]", 1), (json.dumps({"Contents": [{"Key": "k"}]}), 1), ("null", 0)]):
        d = tmp_path / f"doc{n}.json"
        d.write_text(body)
        assert files.read_listing_document(spark, str(d), "b").count() == want
    d.write_text('"text"')
    with pytest.raises(Exception, match="not a listing"):
        files.read_listing_document(spark, str(d), "b").collect()


def test_config_files(spark, tmp_path):
    r = tmp_path / "r.json"
    r.write_text(json.dumps({"buckets": [{"name": "a", "in_scope": None}, {"name": "b", "in_scope": True}], "exclusions": {"_comment": ["x"], "a": ["p/", "q/"], "b": {"pattern": "**/*.eml"}}}))
    assert [x["in_scope"] for x in files.read_registry(spark, str(r)).orderBy("name").collect()] == [None, True]
    assert rows(files.read_exclusions(spark, str(r))) == [("a", "p/"), ("a", "q/")]
    assert rows(files.read_exclusions(spark, str(tmp_path / "none.json"))) == []
    with pytest.raises(FileNotFoundError):
        files.read_registry(spark, str(tmp_path / "none.json"))
    m = tmp_path / "meta"
    m.mkdir()
    (m / "a.meta.json").write_text('{"bucket": "a", "complete": true}')
    (m / "b.meta.json").write_text("not json")
    assert rows(files.read_checkpoints(spark, str(m)).select("bucket", "complete")) == [("a", True), ("b", False)]
    assert files.file_hashes(spark, str(r)).first()["byte_size"] == r.stat().st_size
    files.write_manifest({"b": 1, "a": "é"}, str(tmp_path / "m.json"))
    assert (tmp_path / "m.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    files.write_manifest({"b": 1, "a": "é"}, f"file://{tmp_path}/n.json", spark)
    assert (tmp_path / "n.json").read_text() == (tmp_path / "m.json").read_text()


def test_paged_listing(spark, tmp_path):
    for b in ("x", "y"):
        (tmp_path / b).mkdir()
        for n in range(3):
            (tmp_path / b / f"page-{n}.json").write_text(json.dumps([{"Key": f"{b}{n}{i}", "Size": 1, "ETag": '"e"'} for i in range(2)]))
    spark.dataSource.register(PagedListing)
    opts = {"buckets": "x,y", "path": f"{tmp_path}/{{bucket}}"}
    got = spark.read.format("paged_listing").options(**opts).load()
    assert got.count() == 12 and {r["etag"] for r in got.collect()} == {"e"}


def opaque_pages(options, token):
    page = json.loads((pathlib.Path(options["path"]) / f"{token or 'first'}.json").read_text())
    return page["rows"], page["next"]


def pages(folder, bucket, names):
    (folder / bucket).mkdir()
    for n, (name, following) in enumerate(zip(names, [*names[1:], None])):
        doc = {"rows": [{"Key": f"{bucket}-{n}-{i}", "Size": 2, "ETag": '"e"'} for i in range(3)], "next": following}
        (folder / bucket / f"{name}.json").write_text(json.dumps(doc))


def test_paged_stream_lists_every_bucket_by_opaque_tokens(spark, tmp_path):
    pages(tmp_path, "x", ["first", "qX_9=", "zz~a"])
    pages(tmp_path, "y", ["first", "t-1"])
    spark.dataSource.register(PagedListing)
    opts = {"buckets": "x,y", "path": f"{tmp_path}/{{bucket}}", "fetcher": "tests.test_ledger_and_streams:opaque_pages"}
    want = sorted([f"x-{n}-{i}" for n in range(3) for i in range(3)] + [f"y-{n}-{i}" for n in range(2) for i in range(3)])
    assert sorted(r["key"] for r in spark.read.format("paged_listing").options(**opts).load().collect()) == want
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):  # the second query finds both listings complete
        q = spark.readStream.format("paged_listing").options(**opts).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == want


def test_listing_actions(spark, tmp_path):
    buckets = spark.createDataFrame([("done",), ("half",), ("new",), ("lost",), (None,)], "name string")
    c = spark.createDataFrame([("done", True, None, 5, 50), ("half", False, "t?=", 3, 30), ("lost", False, None, None, None), ("gone", True, None, 1, 1)], "bucket string, complete boolean, continuation_token string, object_count bigint, total_bytes bigint")
    assert rows(listing_actions(buckets, c)) == [("done", "skip", None, 5, 50), ("half", "resume", "t?=", 3, 30), ("lost", "start", None, 0, 0), ("new", "start", None, 0, 0)]
    assert [r[1:] for r in rows(listing_actions(buckets, c, force=True))] == [("restart", None, 0, 0)] * 3 + [("start", None, 0, 0)]
    assert resumed_options(listing_actions(buckets, c)) == {"buckets": "half,lost,new", "tokens": '{"half": "t?="}'}
    assert rows(listing_totals(c)) == [(4, 9, 81, "half,lost")] and rows(listing_totals(c.where("false"))) == [(0, 0, 0, "")]
    pages(tmp_path, "half", ["first", "t", "u"])
    spark.dataSource.register(PagedListing)
    opts = {"buckets": "half", "tokens": '{"half": "t"}', "path": f"{tmp_path}/{{bucket}}", "fetcher": "tests.test_ledger_and_streams:opaque_pages"}
    assert spark.read.format("paged_listing").options(**opts).load().count() == 6


def test_listing_stream_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"bucket": "b", "key": f"k{n}{i}", "size": 4}) for i in range(3)))
    q = SL.listing_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [(p["observedMetrics"]["listed"]["objects"], p["observedMetrics"]["listed"]["bytes"]) for p in q.recentProgress if p["numInputRows"]] == [(3, 12)] * 2


def test_failed_events_keep_only_their_error(spark):
    items = spark.createDataFrame([("k", "r", "s", "e", 5, "x" * 3000)], "s3_key string, record_id string, text_sha256 string, etag string, byte_size bigint, error string")
    for status in ("failed", "skipped"):
        r = L.event(items, status).first()
        assert (r["etag"], r["byte_size"], r["record_id"], len(r["error"])) == (None, None, None, 2000)
    assert L.event(items, "done").first()["etag"] == "e"
