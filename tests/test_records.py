import json

import pytest
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.operators import records as R
from holdfast.sources import files
from tests.conftest import rows


def record(**k):
    base = {"title": "t", "source_site": "site_a", "content_type": "pdf", "provenance": {"s3_key": "k", "byte_size": 3}, "body_text": "hello  world", "capture_date": "2026-01-01T00:00:00+00:00", "schema_version": "1"}
    return base | k


@pytest.fixture
def made(spark):
    data = [record(), record(provenance={"s3_key": "k2", "original_url": ""}, body_text=None), record(provenance={"s3_key": "k", "original_url": "http://x"}, body_text="hello world")]
    return R.derived(spark.createDataFrame(data, schemas.RECORD))


def test_derived_fields(made):
    a = made.orderBy("id").collect()
    assert all(r["id"].startswith("site_a-") and len(r["text_sha256"]) == 64 and r["topics"] == [] and r["extraction"]["status"] == "ok" for r in a)
    assert {r["extraction"]["char_count"] for r in a} == {0, 11, 12}
    assert rows(R.violations(made)) == []


def test_duplicates_point_to_the_least_id(spark):
    h = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, None)], "id int, text_sha256 string")
    want = sorted([(3, "x", 1), (1, "x", None), (2, "y", None), (4, None, None), (5, None, None)], key=repr)
    assert rows(R.duplicate_of(h)) == want == rows(R.first_by_window(h))
    assert rows(R.content_groups(h)) == [("x", 2, 1)]


def test_violations(spark):
    bad = record(id="BAD", title="", content_type="pie", text_sha256="zz", topics=["a", "a"], extraction={"status": "ok", "ocr_confidence": 101.0}, schema_version="2", publication_date="19")
    got = {r["rule"] for r in R.violations(spark.createDataFrame([bad], schemas.RECORD)).collect()}
    assert got == {"required:title", "enum:content_type", "pattern:id", "pattern:text_sha256", "pattern:publication_date", "unique:topics", "range:extraction.ocr_confidence", "const:schema_version"}


def test_json_lines_round_trip(spark, made, tmp_path):
    assert files.write_records(made, str(tmp_path / "r")) == 3
    line = spark.read.text(str(tmp_path / "r")).first()[0]
    assert list(json.loads(line)) == sorted(json.loads(line)) and "duplicate_of" in json.loads(line)
    back = files.read_records(spark, str(tmp_path / "r"))
    assert rows(back.select("id", "text_sha256")) == rows(made.select("id", "text_sha256"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.jsonl").write_text('\n{"title": "t", "colour": 1}\n')
    with pytest.raises(Exception, match="unknown fields"):
        files.read_records(spark, str(tmp_path / "bad")).collect()


def test_checksums_don_t_see_layout(spark):
    df = spark.createDataFrame([("a", "x  y\n"), ("b", "x y"), ("c", "café"), ("d", "café"), ("e", None), ("f", "")], "id string, body_text string")
    c = {r["id"]: r["text_sha256"] for r in R.checksums(df).collect()}
    assert c["a"] == c["b"] and c["c"] == c["d"] and c["e"] == c["f"] and len(c) == 6


def test_dangling(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", "a", "x"), ("c", "a", "y"), ("d", "zz", "x")], "id string, duplicate_of string, text_sha256 string")
    assert rows(R.dangling_duplicates(df)) == [("c", "a"), ("d", "zz")]
    assert df.select(F.count("*")).first()[0] == 4


def test_html_text(spark):
    from holdfast.functions.html import html_to_text

    cases = {
        "<h1>A</h1><p>x <b>y</b>&amp;z&nbsp;q</p><script>no()</script><!-- c --><ul><li>one<li>two</ul>": "A\n\nx y&z q\n\none\ntwo",
        "a < b and c > d": "a < b and c > d",
        "": "",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate([*cases, None])], "i int, h string")
    assert [r[1] for r in df.select("i", html_to_text(F.col("h"))).orderBy("i").collect()] == [*cases.values(), None]


@pytest.mark.parametrize(
    "field,values",
    [
        ("content_type", ["pdf", "html", "image", "office", "video", "audio", "text", "other"]), ("publication_date_precision", ["day", "month", "year"]),
        ("publication_date_source", ["document_metadata", "page_byline", "url_path", "filename", "manual"]), ("retrieved_from", ["s3_archive", "live_site", "wayback"]),
        ("status", ["ok", "empty", "ocr", "ocr_low_confidence", "failed", "skipped"]), ("method", ["pdftotext", "tesseract", "textract", "html_extract", "plain"]),
    ],
)
def test_every_value_of_an_enumeration(spark, field, values):
    whole = {"content_type": "content_type", "retrieved_from": "provenance.retrieved_from", "status": "extraction.status", "method": "extraction.method"}.get(field, field)
    data = []
    for n, v in enumerate([*values, "metadata", "unknown", None]):
        r = record(id=f"s-{n:012x}", text_sha256="a" * 64, extraction={"status": "ok"})
        if "." in whole:
            part = whole.split(".")[0]
            r[part] = r[part] | {field: v}
        else:
            r[field] = v
        data.append(r)
    got = {(r["id"], r["rule"]) for r in R.violations(spark.createDataFrame(data, schemas.RECORD)).collect()}
    n = len(values)
    want = {(f"s-{i:012x}", f"enum:{whole}") for i in (n, n + 1)}
    assert got == want | ({(f"s-{n + 2:012x}", "required:content_type")} if field == "content_type" else set())


def test_duplicates_that_dangle(spark):
    data = [record(id=i, duplicate_of=d, text_sha256=h, capture_date=f"2026-01-0{t}T00:00:00Z") for i, d, h, t in [("a", None, "x", 1), ("b", "a", "x", 2), ("c", "a", "y", 2), ("d", "d", "x", 1), ("e", "b", "x", 1), ("f", "none", "x", 1)]]
    assert [r[0] for r in rows(R.dangling_duplicates(spark.createDataFrame(data, schemas.RECORD)))] == ["c", "d", "e", "f"]


def test_display_text(spark):
    data = [(1, "a\n \n \nb"), (2, "a\n\n\n\nb\xa0\tc "), (3, None), (4, ""), (5, "e\u0301")]
    got = {r["id"]: r["display_text"] for r in R.displayed(spark.createDataFrame(data, "id int, body_text string")).collect()}
    assert got == {1: "a\n\n\nb", 2: "a\n\nb c", 3: None, 4: "", 5: "\xe9"}


def test_with_ledger(spark):
    h = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "id string, text_sha256 string")
    seen = spark.createDataFrame([("x", "r1", 3), ("z", "r2", 1)], "text_sha256 string, record_id string, keys bigint")
    assert rows(R.with_ledger(h, seen)) == [("a", "x", "r1", 3), ("b", "x", "r1", 3), ("c", "y", None, 0), ("d", None, None, 0)]
