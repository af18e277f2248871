"""Document records: derivation of fields, content duplicates, validation, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from holdfast.functions import scalars as S
from holdfast.operators.rows import balanced, one_per_key

# The record's enumerations and patterns.
ENUMS = {
    "content_type": ("pdf", "html", "image", "office", "video", "audio", "text", "other"),
    "publication_date_precision": ("day", "month", "year"),
    "publication_date_source": ("document_metadata", "page_byline", "url_path", "filename", "manual"),
    "provenance.retrieved_from": ("s3_archive", "live_site", "wayback"),
    "extraction.status": ("ok", "empty", "ocr", "ocr_low_confidence", "failed", "skipped"),
    "extraction.method": ("pdftotext", "tesseract", "textract", "html_extract", "plain"),
}
PATTERNS = {
    "id": r"^[a-z0-9][a-z0-9_-]*-[0-9a-f]{12}$",
    "source_site": r"^[a-z0-9_]+$",
    "publication_date": r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$",
    "provenance.file_sha256": r"^[0-9a-f]{64}$",
    "text_sha256": r"^[0-9a-f]{64}$",
}
REQUIRED = ("id", "title", "source_site", "content_type", "capture_date", "text_sha256", "provenance.s3_key")
SCHEMA_VERSION = "1"


def composed(df: DataFrame, col: str, out: str = "composed") -> DataFrame:
    """``df`` with the text composed by Unicode; only rows that may need it go through Python."""
    df = balanced(df)
    plain = df.where(F.col(col).isNull() | ~S.needs_nfc(F.col(col))).withColumn(out, F.col(col))
    rest = df.where(S.needs_nfc(F.col(col))).withColumn(out, S.nfc(F.col(col)))
    return plain.unionByName(rest)


def unique_records(records: DataFrame) -> DataFrame:
    """One row for each id, that with the latest ``capture_date``."""
    return one_per_key(records, "id", "capture_date")


def checksums(records: DataFrame, id_col: str = "id", text_col: str = "body_text") -> DataFrame:
    """``(id, text_sha256, char_count, display_length)`` computed from the text; a NULL text counts as an empty one."""
    t = records.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    c = composed(t, "text")
    return c.select("id", S.text_checksum(F.col("composed")).alias("text_sha256"), F.length("text").cast("bigint").alias("char_count"), F.length(S.display_text(F.col("composed"))).cast("bigint").alias("display_length"))


def derived(records: DataFrame) -> DataFrame:
    """Records with what is absent filled in: id, text_sha256, extraction.char_count, and the defaults.

    A record without site or locator raises.
    """
    r = composed(records.withColumn("body_text", F.coalesce("body_text", F.lit(""))), "body_text")
    made = S.stable_id(F.col("source_site"), S.locator(F.col("provenance.original_url"), F.col("provenance.s3_key")))
    ext = F.coalesce(F.col("extraction"), F.from_json(F.lit('{"status":"ok"}'), "status string, method string, char_count bigint, ocr_confidence double, error string, tool_version string"))
    return r.select(
        *[F.col(c) for c in records.columns if c not in ("id", "text_sha256", "extraction", "topics", "schema_version", "title_inferred", "capture_date")],
        F.coalesce(F.nullif("id", F.lit("")), made).alias("id"),
        F.coalesce(F.nullif("text_sha256", F.lit("")), S.text_checksum(F.col("composed"))).alias("text_sha256"),
        ext.withField("char_count", F.coalesce(F.col("extraction.char_count"), F.length("body_text").cast("bigint"))).withField("status", F.coalesce(F.col("extraction.status"), F.lit("ok"))).alias("extraction"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        F.coalesce("schema_version", F.lit(SCHEMA_VERSION)).alias("schema_version"),
        F.coalesce("title_inferred", F.lit(False)).alias("title_inferred"),
        F.coalesce("capture_date", S.utc_now()).alias("capture_date"),
    )


def displayed(records: DataFrame, id_col: str = "id", text_col: str = "body_text") -> DataFrame:
    """``(id, display_text)``: the text made readable; NULL stays NULL."""
    c = composed(records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    return c.select("id", S.display_text(F.col("composed")).alias("display_text"))


def with_ledger(hashed: DataFrame, seen: DataFrame) -> DataFrame:
    """``(id, text_sha256, seen_as, keys)``: each document with the ledger's record of the same text and the number of its keys, NULL
    and 0 where there is none. ``seen`` has one row for each text, so that copies multiply nothing."""
    s = seen.select("text_sha256", F.col("record_id").alias("seen_as"), "keys")
    return hashed.join(s, "text_sha256", "left").select("id", "text_sha256", "seen_as", F.coalesce("keys", F.lit(0)).cast("bigint").alias("keys"))


def duplicate_of(hashed: DataFrame) -> DataFrame:
    """``(id, text_sha256, duplicate_of)``: all but the least id of a checksum point to that one; every row is kept.

    The least id of each checksum is found by aggregation, so that one checksum's rows never meet in one task.
    Broadcast or not, the join's other side has one row for each repeated checksum.
    """
    first = hashed.where("text_sha256 IS NOT NULL").groupBy("text_sha256").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    j = hashed.join(first, "text_sha256", "left")
    return j.select("id", "text_sha256", F.when(F.col("id") != F.col("first"), F.col("first")).alias("duplicate_of"))


def content_groups(hashed: DataFrame) -> DataFrame:
    """``(text_sha256, copies, first_id)`` of checksums with more than one record."""
    return hashed.where("text_sha256 IS NOT NULL").groupBy("text_sha256").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


def violations(records: DataFrame) -> DataFrame:
    """``(id, rule)``: every constraint that a record breaks. NULL is allowed where a field isn't required."""

    def rule(name: str, bad: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(name))

    rules = [rule(f"required:{c}", F.coalesce(F.col(c), F.lit("")) == "") for c in REQUIRED]
    rules += [rule(f"pattern:{c}", ~F.col(c).rlike(p)) for c, p in PATTERNS.items()]
    rules += [rule(f"enum:{c}", ~F.col(c).isin(*v)) for c, v in ENUMS.items()]
    rules += [
        rule("range:provenance.byte_size", F.col("provenance.byte_size") < 0),
        rule("range:extraction.char_count", F.col("extraction.char_count") < 0),
        rule("range:extraction.ocr_confidence", ~F.col("extraction.ocr_confidence").between(0, 100)),
        rule("unique:topics", F.size(F.array_distinct("topics")) != F.size("topics")),
        rule("const:schema_version", F.col("schema_version") != SCHEMA_VERSION),
    ]
    broken = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return records.select("id", F.explode(broken).alias("rule"))


def dangling_duplicates(records: DataFrame) -> DataFrame:
    """``(id, duplicate_of)`` that refer to no other record with the same text checksum captured no later, as far as
    both have a ``capture_date`` that can be read."""
    if "capture_date" not in records.columns:
        records = records.withColumn("capture_date", F.lit(None).cast("string"))
    a = records.where("duplicate_of IS NOT NULL").select("id", "duplicate_of", "text_sha256", F.try_to_timestamp("capture_date").alias("t"))
    b = records.select(F.col("id").alias("target"), F.col("text_sha256").alias("sha"), F.try_to_timestamp("capture_date").alias("before"))
    same = (F.col("duplicate_of") == F.col("target")) & (F.col("text_sha256") == F.col("sha")) & (F.col("id") != F.col("target"))
    return a.join(b, same & F.coalesce(F.col("before") <= F.col("t"), F.lit(True)), "left_anti").select("id", "duplicate_of")


def to_json_lines(records: DataFrame) -> DataFrame:
    """``(value)``: a JSON object a record, keys in order, NULLs written."""

    def ordered(name: str, kind) -> Column:
        if isinstance(kind, StructType):
            return F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{name}.{f.name}").alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
        return F.col(name)

    cols = [ordered(f.name, f.dataType).alias(f.name) for f in sorted(records.schema, key=lambda f: f.name)]
    return records.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def first_by_window(hashed: DataFrame) -> DataFrame:
    """:func:`duplicate_of` by window, for comparison in tests."""
    w = Window.partitionBy("text_sha256").orderBy("id")
    first = F.first("id").over(w)
    return hashed.select("id", "text_sha256", F.when(F.col("text_sha256").isNotNull() & (F.col("id") != first), first).alias("duplicate_of"))
