"""Tables in and out, and written intermediate results.

Lineage is cut only with tables written to the shared folder that the session names in
``spark.checkpoint.dir``; nothing lives on one executor's disk alone, so a lost executor costs
no more than its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="holdfast-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return it read back: later uses don't recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/holdfast/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a written table has at most ``max_rows`` rows; reads parquet footers only."""
    return df.count() <= max_rows


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`written` left in the shared folder. Call it when results are stored."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(base.rstrip("/") + "/holdfast")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
