"""Ledger and listing as streams: file sources drained with ``availableNow``, state in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast import schemas
from holdfast.operators.ledger import FIELDS


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Ledger events from a folder of parquet files, new files being picked up."""
    r = spark.readStream.schema(schemas.LEDGER)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def streamed_state(events: DataFrame) -> DataFrame:
    """The latest state of each key as a streaming aggregate, for complete or update mode; late and repeated events change nothing."""
    rest = F.struct(F.try_to_timestamp("updated_at").alias("t"), "attempts", "log_seq", *[c for c in FIELDS if c != "attempts"])
    best = events.where("s3_key IS NOT NULL").groupBy("s3_key").agg(F.max(rest).alias("r"))
    return best.select("s3_key", *[F.col(f"r.{c}").alias(c) for c in FIELDS])


def maintain(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Fold new events into parquet folders under ``target``, one for each micro-batch, holding the keys that changed.

    A batch that is run again after a failure overwrites its own folder. :func:`current` reads the result.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    q = streamed_state(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return q.start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The states that :func:`maintain` has written: of each key the one of the latest batch."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(target)
    best = rows.groupBy("s3_key").agg(F.max(F.struct("_batch", *FIELDS)).alias("r"))
    return best.select("s3_key", *[F.col(f"r.{c}").alias(c) for c in FIELDS])


def listing_stream(spark: SparkSession, path: str, target: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Listing files into parquet as they come; a restarted query goes on after the last committed file.

    The progress of each batch holds its objects and bytes, under ``observedMetrics["listed"]``.
    """
    raw = spark.readStream.schema("bucket string, key string, size bigint, modified string, etag string, class string").option("maxFilesPerTrigger", files_per_batch).json(path)
    raw = raw.observe("listed", F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return raw.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events by status in windows of event time, with a watermark: later ones are dropped, states stay bounded."""
    t = events.withColumn("t", F.try_to_timestamp("updated_at")).withWatermark("t", late)
    return t.groupBy(F.window("t", width).alias("w"), "status").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "status", "events")
