"""Per-key totals where a few keys hold most rows (problem 7).

Aggregation is pushed through every join: each input is first reduced to one compact state per join
key, map-side, the states are joined, and counts are multiplied or sums combined algebraically. A
hot key is then a single row on either side, whatever its share of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.incremental import bare_etag


def distinct_batches(candidates: DataFrame) -> DataFrame:
    """``(batch_id, etag, copies)``: each batch once per ETag, quotes removed; the exchange is by batch and ETag.

    A batch delivered twice counts once (with its greatest ``copies``); rows without ``batch_id`` are left out.
    """
    return (
        candidates.where("batch_id IS NOT NULL")
        .select("batch_id", bare_etag(F.col("etag")).alias("etag"), F.col("copies").cast("bigint").alias("copies"))
        .groupBy("batch_id", "etag")
        .agg(F.max("copies").alias("copies"))
    )


def batch_totals(candidates: DataFrame) -> DataFrame:
    """``(etag, batches, copies)`` over distinct batches. One row per ETag, the NULL ETag among them."""
    return distinct_batches(candidates).groupBy("etag").agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("copies"), F.lit(0)).alias("copies")
    )


def key_totals(candidates: DataFrame) -> DataFrame:
    """``(etag, distinct_keys)``: the exchange that removes repeats is by ETag and key, so no ETag is hot in it."""
    pairs = candidates.where("batch_id IS NOT NULL").select(
        bare_etag(F.col("etag")).alias("etag"), F.explode("keys").alias("k")
    )
    return pairs.where("k IS NOT NULL").distinct().groupBy("etag").agg(F.count("*").alias("distinct_keys"))


def totals_per_etag(candidates: DataFrame) -> DataFrame:
    """``(etag, batches, copies, distinct_keys)`` per ETag; an ETag without keys has 0."""
    b, k = batch_totals(candidates).alias("b"), key_totals(candidates).alias("k")
    return b.join(k, F.col("b.etag").eqNullSafe(F.col("k.etag")), "left").select(
        "b.etag", "b.batches", "b.copies", F.coalesce("k.distinct_keys", F.lit(0)).alias("distinct_keys")
    )


def joined_totals(candidates: DataFrame, listing: DataFrame) -> DataFrame:
    """Totals of the join of batches with listed objects on the ETag, without making the join.

    ``(etag, batches, objects, pairs, pair_bytes)``: ``pairs`` is the number of rows the plain join
    would have, ``pair_bytes`` the sum of ``size`` over them. ETags that one side lacks, and NULL, don't join.
    """
    left = distinct_batches(candidates).where("etag IS NOT NULL").groupBy("etag").agg(F.count("*").alias("batches"))
    right = (
        listing.select(bare_etag(F.col("etag")).alias("etag"), F.coalesce("size", F.lit(0)).alias("size"))
        .where("etag IS NOT NULL")
        .groupBy("etag")
        .agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
    )
    return left.join(right, "etag").select(
        "etag",
        "batches",
        "objects",
        (F.col("batches") * F.col("objects")).alias("pairs"),
        (F.col("batches").cast("decimal(38,0)") * F.col("bytes")).alias("pair_bytes"),
    )


def heavy_etags(candidates: DataFrame, share: float = 0.025) -> DataFrame:
    """``(etag)``: ETags holding at least ``share`` of the distinct batches (those without an ETag among them)."""
    total = candidates.agg(F.count_distinct("batch_id").alias("total"))
    per = batch_totals(candidates).where("etag IS NOT NULL")
    # total is one row
    return per.join(F.broadcast(total), per["batches"] >= F.col("total") * F.lit(share)).select("etag")
