import hashlib
import pathlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from holdfast.functions import scalars as S

KEYS = ["a/b.PDF", ".bashrc", "a.", "..foo", "a/b.c/", "a.tar.gz", "x/._n.pdf", "a//b.x", "dir.x/.", "Icon\r", "a.b.", "x.pdf ", "/", "a/.pdf", "a. b", "a\nb.txt", "a/./b.q/./", "a.jsonld", "a.pages", "", "/x", "a/b/c/d.md"]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_names_are_as_the_path_library_has_them(spark):
    assert column(spark, KEYS, S.basename) == [pathlib.PurePosixPath(k).name for k in KEYS]
    assert column(spark, KEYS, S.suffix) == [pathlib.PurePosixPath(k).suffix.lower() for k in KEYS]


def test_extension(spark):
    assert column(spark, ["a.jsonld", "b.pages", "c.shtml", "d.numbers", "e"], S.extension) == ["(none)", ".pages", ".shtml", "(none)", "(none)"]


@pytest.mark.parametrize("key,noise", [("x/", True), ("__MACOSX/a", True), ("d/x.key/Data/s.jpg", True), ("a/._b", True), ("a/.DS_Store", True), ("Icon\r", True), ("T/X.pages", False), ("a/b.pdf", False), ("X.KEY/a", False)])
def test_noise(spark, key, noise):
    assert column(spark, [key], S.is_noise) == [noise]


def test_two_classifications(spark):
    keys = ["a.ppt", "a.md", "a.xls", "a.shtml", "a.eml", "a.pages", "a.m4a", "a.css", "a.PDF", "b/"]
    assert column(spark, keys, S.content_type) == ["office", "text", "office", "html", "other", "other", "other", "other", "pdf", "other"]
    assert column(spark, keys, S.material) == ["media", "other", "other", "other", "document", "document", "media", "web", "document", "noise"]


def test_prefixes(spark):
    keys = ["a/b/c", "a/b", "a", "/x", "a//b", "a/b/c/d"]
    assert column(spark, keys, S.prefix) == ["a/b", "a", "(root)", "(root)", "a/", "a/b"]
    assert column(spark, keys, S.top_prefix) == ["a", "a", "(root)", "", "a", "a"]


def test_sizes(spark):
    edges = [0, 99_999, 100_000, 999_999, 1_000_000, 9_999_999, 10_000_000, 99_999_999, 100_000_000, -1]
    assert column(spark, edges, S.stratum, "bigint") == ["tiny", "tiny", "small", "small", "medium", "medium", "large", "large", "huge", "huge"]
    assert column(spark, [0, 1023, 1024, 1536, 1024**2, 5 * 1024**3, 1024**4, 2000 * 1024**4], S.human_bytes, "bigint") == ["0 B", "1,023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB", "1.0 TB", "2,000.0 TB"]


TEXTS = ["a  b\tc", " x y ", "café", "a b　c", "\x1c a \x1f", "a\x0bb\x0cc", "", "a\n\n\n\nb", "a\n \n \nb", "x\u0085y", "  a  \n  b  "]


def test_texts_are_as_in_python(spark):
    composed = [unicodedata.normalize("NFC", t) for t in TEXTS]
    assert column(spark, TEXTS, S.nfc) == composed
    canonical = [re.sub(r"\s+", " ", t.replace("\xa0", " ")).strip() for t in composed]
    assert column(spark, composed, S.canonical_text) == canonical
    assert column(spark, composed, S.text_checksum) == [hashlib.sha256(t.encode()).hexdigest() for t in canonical]

    def shown(t):
        t = re.sub(r"[ \t\r\f\v]+", " ", t.replace("\xa0", " "))
        t = re.sub(r"\n{3,}", "\n\n", t)
        return "\n".join(x.strip() for x in t.split("\n")).strip()

    assert column(spark, composed, S.display_text) == [shown(t) for t in composed]
    assert column(spark, composed, S.spaceless_length) == [len(re.sub(r"\s+", "", t)) for t in composed]
    assert column(spark, ["abc", "é", "é"], S.needs_nfc) == [False, False, True]


def test_identifiers(spark):
    df = spark.createDataFrame([("My Site!", " http://x/ ")], "s string, l string")
    slug, loc = "my-site", "http://x/"
    assert df.select(S.stable_id(F.col("s"), F.col("l"))).first()[0] == f"{slug}-{hashlib.sha256((slug + chr(0) + loc).encode()).hexdigest()[:12]}"
    with pytest.raises(Exception, match="must not be empty"):
        spark.createDataFrame([("", "x")], "s string, l string").select(S.stable_id(F.col("s"), F.col("l"))).collect()


def test_pages_are_rounded_before_thresholds(spark):
    df = spark.createDataFrame([(4996, 100), (0, 0)], "c bigint, p bigint").select(S.chars_per_page(F.col("c"), F.col("p"), 100))
    assert [r[0] for r in df.collect()] == [50.0, None]
    assert column(spark, ["Pages: 12\nProducer: X: y"], lambda c: S.info_field(c, "Producer")) == ["X: y"]
    assert column(spark, ["2012-x", "20x2", None], S.modified_year) == ["2012", None, None]
    assert column(spark, ['"a-2"', "abc", "", None], lambda c: S.is_content_hash(S.bare(c))) == [False, True, False, False]
    assert spark.range(1).select(S.utc_now().alias("n")).first()[0].endswith("+00:00")
