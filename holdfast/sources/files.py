"""Readers and writers of listings, registries, exclusions, checkpoints and records as files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from holdfast import schemas
from holdfast.operators.records import to_json_lines

_FIELDS = ("Key", "Size", "Modified", "ETag", "Class")


def _lowered(raw: DataFrame, bucket) -> DataFrame:
    return raw.select(bucket.alias("bucket"), *[F.col(c).alias(c.lower()) for c in _FIELDS])


def read_listing(spark: SparkSession, path: str, strict: bool = True, unique: bool = True, partitions: int | None = None) -> DataFrame:
    """``(bucket, key, size, modified, etag, class)`` of ``<bucket>.jsonl.gz`` files, a JSON object a line.

    All members of a gzip file are read, blank lines skipped. A bad line raises, or is left out where not
    ``strict``. A resumed listing repeats keys: one row is kept for each, the greatest, unless ``unique`` is off. Gzip
    files can't be split; ``partitions`` spreads their rows for what follows.
    """
    reader = spark.read.schema(schemas.LISTING).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    bucket = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl\.gz$", 1)
    rows = _lowered(reader.json(path), bucket).where("key IS NOT NULL")
    if partitions:
        rows = rows.repartition(partitions)
    if unique:
        best = rows.groupBy("bucket", "key").agg(F.max(F.struct("modified", "size", "etag", "class")).alias("r"))
        rows = best.select("bucket", "key", "r.size", "r.modified", "r.etag", "r.class")
    return rows


def read_listing_document(spark: SparkSession, path: str, bucket: str) -> DataFrame:
    """A listing held as one JSON document: an array, an object with ``Contents``, or ``null``; another shape raises."""
    kind = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in schemas.LISTING.split(', '))}>>"
    doc = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
    items = (
        F.when(F.col("v") == "null", F.from_json(F.lit("[]"), kind))
        .when(F.col("v").startswith("["), F.from_json("v", kind))
        .when(F.get_json_object("v", "$.Contents").isNotNull(), F.from_json(F.get_json_object("v", "$.Contents"), kind))
        .when(F.col("v") == "{}", F.from_json(F.lit("[]"), kind))
        .otherwise(F.raise_error(F.lit("not a listing")).cast(kind))
    )
    return _lowered(doc.select(F.explode(items).alias("x")).select("x.*"), F.lit(bucket))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The bucket registry; a missing file raises. ``in_scope`` stays NULL where undecided."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    kind = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in schemas.REGISTRY.split(', '))}>>"
    doc = spark.read.option("wholetext", True).text(path)
    return doc.select(F.explode(F.from_json(F.get_json_object("value", "$.buckets"), kind)).alias("b")).select("b.*")


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """``(bucket, prefix)``: entries that are lists and no comments. A missing file excludes nothing."""
    empty = spark.createDataFrame([], "bucket string, prefix string")
    if "://" not in path and not Path(path).exists():
        return empty
    doc = spark.read.option("wholetext", True).text(path)
    entries = F.from_json(F.coalesce(F.get_json_object("value", "$.exclusions"), F.col("value")), "map<string,string>")
    e = doc.select(F.explode(entries).alias("bucket", "v")).where(F.col("v").startswith("[") & ~F.col("bucket").startswith("_"))
    return e.select("bucket", F.explode(F.from_json("v", "array<string>")).alias("prefix"))


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Listing checkpoints, a JSON document a file; what can't be read is a row of NULLs with ``complete`` false."""
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json("value", schemas.LISTING_META).alias("m"), F.col("_metadata.file_name").alias("f"))
    return doc.select(F.coalesce("m.bucket", F.regexp_extract("f", r"^(.*?)\.", 1)).alias("bucket"), *[F.col(f"m.{c}").alias(c) for c in ("region", "object_count", "total_bytes", "continuation_token", "updated_at", "error")], F.coalesce("m.complete", F.lit(False)).alias("complete"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as JSON lines; blank lines are skipped, bad lines and unknown fields raise."""
    names = [f.name for f in _record_schema()]
    lines = spark.read.text(path).where("trim(value) <> ''")
    unknown = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, names)))
    checked = F.when(unknown.isNull() | (F.size(unknown) > 0), F.raise_error(F.concat(F.lit("unknown fields or no object: "), F.coalesce(F.array_join(unknown, ", "), F.col("value"))))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked.cast("string"), schemas.RECORD, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _record_schema() -> StructType:
    return _parse_datatype_string(schemas.RECORD)  # type: ignore[return-value]


def write_records(records: DataFrame, path: str) -> int:
    """Records as JSON lines with ordered keys and NULLs, replacing what is there; returns their number."""
    seen = Observation()
    to_json_lines(records).observe(seen, F.count("*").alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, byte_size, file_sha256)`` of files' raw bytes. Each is read whole, up to two gigabytes."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("file_sha256"))


def append_listing(rows: DataFrame, path: str) -> None:
    """Append listed objects as gzip JSON lines, in new files."""
    rows.write.mode("append").option("compression", "gzip").json(path)


def write_manifest(document: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small document as JSON: ordered keys, two spaces, a line end at the end. A path with a scheme is written by the session's file systems."""
    text = json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    if spark is None or "://" not in path:
        Path(path).write_text(text, encoding="utf-8")
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
