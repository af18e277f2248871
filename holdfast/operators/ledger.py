"""The ingestion ledger as a log of events folded to the latest state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import scalars as S

FIELDS = ("record_id", "text_sha256", "etag", "byte_size", "status", "attempts", "error", "updated_at")


def state(log: DataFrame) -> DataFrame:
    """The state of each key: its event with the latest time, then the most attempts, then the last to arrive.

    The whole event replaces what was there: a failure after a success leaves no record id or checksum.
    """
    rest = F.struct(F.try_to_timestamp("updated_at").alias("t"), "attempts", "log_seq", *[c for c in FIELDS if c != "attempts"])
    best = log.where("s3_key IS NOT NULL").groupBy("s3_key").agg(F.max(rest).alias("r"))
    return best.select("s3_key", *[F.col(f"r.{c}").alias(c) for c in FIELDS])


def upserted(events: DataFrame) -> DataFrame:
    """The fold of events ``(seq, s3_key, ...)`` in which ``attempts`` is the number of a key's events."""
    keep = [c for c in FIELDS if c != "attempts"]
    best = events.groupBy("s3_key").agg(F.max(F.struct("seq", *keep)).alias("r"), F.count("*").alias("attempts"))
    return best.select("s3_key", *[F.col(f"r.{c}").alias(c) for c in keep], "attempts")


def event(items: DataFrame, status: str, error_chars: int = 2000) -> DataFrame:
    """Events of one status from ``items``; failed and skipped ones keep only their error, cut to its first characters."""
    if status not in ("done", "failed", "skipped"):
        raise ValueError(f"no such status: {status}")
    done = status == "done"
    col = lambda c, kind: F.col(c).cast(kind).alias(c) if c in items.columns and done else F.lit(None).cast(kind).alias(c)
    error = F.left(F.col("error"), F.lit(error_chars)) if "error" in items.columns and not done else F.lit(None)
    return items.select("s3_key", col("record_id", "string"), col("text_sha256", "string"), col("etag", "string"), col("byte_size", "bigint"), F.lit(status).alias("status"), error.cast("string").alias("error"), S.utc_now().alias("updated_at"))


def lookup(folded: DataFrame, keys: DataFrame) -> DataFrame:
    """The states of many keys at once."""
    return folded.join(keys.select("s3_key").distinct(), "s3_key", "left_semi")


def done_keys(folded: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys of ``wanted`` (s3_key, etag) that are done; an ETag absent on either side agrees with any."""
    a, b = wanted.alias("a"), folded.where("status = 'done'").alias("b")
    same = F.coalesce(S.bare(F.col("a.etag")) == S.bare(F.col("b.etag")), F.lit(True))
    return a.join(b, (F.col("a.s3_key") == F.col("b.s3_key")) & same, "left_semi").select("s3_key").distinct()


def seen_texts(folded: DataFrame) -> DataFrame:
    """``(text_sha256, record_id, keys)``: the record of the earliest done key of each text, ties by key."""
    d = folded.where("status = 'done' AND text_sha256 IS NOT NULL")
    first = F.min(F.struct(F.try_to_timestamp("updated_at").alias("t"), "s3_key", "record_id")).alias("m")
    return d.groupBy("text_sha256").agg(first, F.count("*").alias("keys")).select("text_sha256", "m.record_id", "keys")


def status_counts(folded: DataFrame) -> DataFrame:
    return folded.groupBy("status").agg(F.count("*").alias("keys"))


def failures(folded: DataFrame, limit: int = 100) -> DataFrame:
    """The first failed keys by attempts and time, both descending, then key."""
    f = folded.where("status = 'failed'").withColumn("t", F.try_to_timestamp("updated_at"))
    return f.orderBy(F.desc("attempts"), F.desc("t"), "s3_key").limit(limit).select("s3_key", "attempts", "error")
