import pytest

from holdfast.operators import sampling as P
from tests.conftest import rows


def population(spark, **n):
    return spark.createDataFrame([("b", f"{s}{i}", 1, s) for s, k in n.items() for i in range(k)], "bucket string, key string, size bigint, stratum string")


@pytest.mark.parametrize("n,total,least,want", [({"a": 900, "b": 100}, 100, 0, {"a": 90, "b": 10}), ({"a": 999, "b": 10}, 100, 5, {"a": 99, "b": 5}), ({"a": 3}, 100, 50, {"a": 3}), ({"a": 1, "b": 3}, 2, 0, {"a": 0, "b": 2})])
def test_allocation(spark, n, total, least, want):
    assert {r["stratum"]: r["sampled"] for r in P.allocation(population(spark, **n), total, least).collect()} == want


def test_published_allocation_and_estimate(spark):
    n = {"tiny": 16701, "small": 19294, "medium": 11855, "large": 2987, "huge": 292}
    whole = sum(n.values())
    got = {k: min(v, max(40, round(1500 * v / whole))) for k, v in n.items()}
    assert got == {"tiny": 490, "small": 566, "medium": 348, "large": 88, "huge": 40}
    share = {"tiny": 0.094, "small": 0.182, "medium": 0.270, "large": 0.443, "huge": 0.200}
    alloc = spark.createDataFrame([(k, v, got[k]) for k, v in n.items()], "stratum string, population bigint, sampled bigint")
    results = spark.createDataFrame([(k, "needs_ocr" if i < share[k] * got[k] else "text_layer", 10) for k in n for i in range(got[k])], "stratum string, verdict string, pages bigint")
    e = P.estimate(results, alloc).first()
    assert e["ocr_share"] == pytest.approx(0.189, abs=0.003) and (e["ci_low"], e["ci_high"]) == (pytest.approx(0.17, abs=0.004), pytest.approx(0.208, abs=0.004))
    assert e["population"] == whole and e["corpus_pages"] == whole * 10


def test_naive_product_overstates(spark):
    alloc = spark.createDataFrame([("s", 100, 4)], "stratum string, population bigint, sampled bigint")
    r = spark.createDataFrame([("s", "needs_ocr", 2), ("s", "needs_ocr", 2), ("s", "text_layer", 50), ("s", "text_layer", 50)], "stratum string, verdict string, pages bigint")
    e = P.estimate(r, alloc).first()
    assert e["pages_needing_ocr"] == 100 and e["naive_pages"] == 1300.0 and e["usd"] == 0.15


def test_draw_is_exact_and_stable(spark):
    p = population(spark, a=5000, b=30)
    a = P.allocation(p, 100, 10)
    want = rows(P.draw(p, a, 1))
    assert rows(P.draw(p.repartition(9), a, 1)) == want != rows(P.draw(p, a, 2))
    n = {r["stratum"]: r["sampled"] for r in a.collect()}
    assert {s: sum(w[3] == s for w in want) for s in n} == n
    assert rows(P.draw(p.where("false"), P.allocation(p.where("false"), 10, 1), 1)) == []


def test_population_filters(spark):
    o = spark.createDataFrame([("b", "ftp/a.pdf", 5), ("b", "x/A.PDF", 5), ("c", "ftp/a.pdf", 5), ("b", "x/._a.pdf", 5), ("b", "z.pdf", 0), ("b", "z.doc", 5), ("b", ".pdf", 200_000)], "bucket string, key string, size bigint")
    x = spark.createDataFrame([("b", "ftp/")], "bucket string, prefix string")
    assert rows(P.ingestable(o, x).select("bucket", "key", "stratum")) == [("b", ".pdf", "small"), ("b", "x/A.PDF", "tiny"), ("c", "ftp/a.pdf", "tiny")]
    assert [r[1] for r in rows(P.excluded_by_pattern(spark.createDataFrame([("b", "a/b/x.EML"), ("b", "x.eml"), ("b", "x.emlx")], "bucket string, key string")))] == ["a/b/x.EML", "x.eml"]


def test_verdict_precedence(spark):
    m = spark.createDataFrame(
        [(300_000_000, "corrupt", None, None), (1, "encrypted", None, None), (1, None, 0, None), (1, "timeout", 5, None), (1, None, 5, 49.9), (1, None, 5, 50.0), (1, None, 5, 250.0)],
        "size bigint, failure string, pages bigint, chars_per_page double",
    )
    assert [r["verdict"] for r in P.verdict(m).collect()] == ["skipped_too_large", "encrypted", "corrupt", "timeout", "needs_ocr", "sparse_text", "text_layer"]


def test_counts_by_level(spark):
    alloc = spark.createDataFrame([("s", 10, 2), ("t", 5, 0)], "stratum string, population bigint, sampled bigint")
    r = spark.createDataFrame([("s", "b", "needs_ocr"), ("s", "c", "needs_ocr"), ("t", "c", "corrupt")], "stratum string, bucket string, verdict string")
    got = {tuple(x)[:3]: tuple(x)[3:] for x in P.verdict_counts(r, alloc).collect()}
    assert got["all", "", "needs_ocr"] == (2, 10.0) and got["stratum", "t", "corrupt"] == (1, 0.0) and got["bucket", "c", "needs_ocr"] == (1, 5.0)


def test_measure_reports_missing_tools(spark):
    f = spark.createDataFrame([("b", "k", 3)], "bucket string, key string, size bigint")
    assert P.measure(f, lambda b, k: b"abc", info="no-such-tool").first()["failure"] == "download_failed"


def test_measure_file_by_file(spark, tmp_path):
    info, text = tmp_path / "info", tmp_path / "text"
    info.write_text("#!/bin/sh\nx=$(cat)\ncase $x in bad*) echo broken >&2; exit 1;; lock*) echo 'needs a password' >&2; exit 1;; slow*) sleep 9;; none*) echo 'Title: x';; *) printf 'Producer:  Maker %0100d\nPages:   40\n' 1;; esac\n")
    text.write_text("#!/bin/sh\ncat | tr -d 'x'\n")
    for tool in (info, text):
        tool.chmod(0o755)

    def fetch(bucket, key):
        if key == "gone":
            raise KeyError(key)
        return f"{key} a b".encode()

    f = spark.createDataFrame([("b", k, s) for k, s in [("good", 3), ("bad", 3), ("lock", 3), ("slow", 3), ("none", 3), ("gone", 3), ("big", 300_000_000), ("nosize", None)]], "bucket string, key string, size bigint")
    got = {r["key"]: r for r in P.measure(f, fetch, str(info), str(text), info_seconds=2, tasks=3).collect()}
    assert {k: r["failure"] for k, r in got.items()} == {"good": None, "bad": "corrupt", "lock": "encrypted", "slow": "timeout", "none": None, "gone": "download_failed", "big": None, "nosize": None}
    assert (got["good"]["pages"], got["good"]["chars_scanned"], got["good"]["chars_per_page"]) == (40, 6, 0.2) and len(got["good"]["producer"]) == 80
    assert got["none"]["pages"] == 0 and got["big"]["pages"] is None


def test_failures_and_producers(spark):
    r = spark.createDataFrame([("b", "1", "corrupt", None), ("b", "2", "text_layer", "X"), ("b", "3", "timeout", ""), ("b", "4", "needs_ocr", "X"), ("b", "5", "needs_ocr", "A" * 90)], "bucket string, key string, verdict string, producer string")
    assert [x[1] for x in rows(P.failed(r))] == ["1", "3"]
    assert [tuple(x) for x in P.top_producers(r).collect()] == [("X", 2), ("A" * 80, 1)]
