"""Processing only new or changed records (problem 2).

A manifest lists what earlier runs finished, with the checksum (ETag) and size it had then. A run takes
the listing, anti-joins it against the manifest, writes what is pending once as its work list, its output under
a batch identifier computed from that list, and commits the manifest last. A run that dies anywhere before
the commit leaves the manifest as it was; its successor computes the same batch again, or a larger one where the
listing has grown, and overwrites what isn't committed, so nothing is skipped and nothing is repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "item_key string, etag string, size bigint, status string, seq bigint"


def bare_etag(etag: Column) -> Column:
    """An ETag without surrounding double quotes; NULL where it is absent or empty."""
    return F.nullif(F.trim(etag, F.lit('"')), F.lit(""))


def current_listing(listing: DataFrame, key: str = "key", etag: str = "etag", at: str = "listed_at", size: str | None = None) -> DataFrame:
    """``(item_key, etag)``, and ``size`` where its column is named, of each key's row with the latest ``at``; rows without a key are left out.

    Equal times: the greater ETag, any ETag before none, then the greater size. Row order and repeated rows don't matter.
    """
    more = [F.col(size).cast("bigint").alias("size")] if size else []
    rows = listing.select(F.col(key).alias("item_key"), F.struct(F.col(at).alias("t"), bare_etag(F.col(etag)).alias("etag"), *more).alias("r"))
    best = rows.where("item_key IS NOT NULL").groupBy("item_key").agg(F.max("r").alias("m"))
    return best.select("item_key", "m.etag", *(["m.size"] if size else []))


def folded_manifest(log: DataFrame, key: str = "s3_key", at: str = "updated_at") -> DataFrame:
    """The state of each key from an append-only log of attempts, as ``(item_key, etag, status)``.

    The latest ``at`` (ISO string with offset, compared as an instant) wins, among equal times the
    most attempts, then the greatest ``log_seq``; late and repeated rows change nothing. A row whose
    time can't be read counts as older than any other. Rows without a key are left out.
    """
    rows = log.select(
        F.col(key).alias("item_key"),
        F.struct(
            F.try_to_timestamp(F.col(at)).alias("t"),
            F.col("attempts").alias("n"),
            F.col("log_seq").alias("q"),
            F.col("status").alias("s"),
            bare_etag(F.col("etag")).alias("e"),
        ).alias("r"),
    )
    best = rows.where("item_key IS NOT NULL").groupBy("item_key").agg(F.max("r").alias("m"))
    return best.select("item_key", F.col("m.e").alias("etag"), F.col("m.s").alias("status"))


def pending(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of ``current`` that the next run has to process, each key once.

    Settled, and so removed by the anti-join, is a key whose status is ``done`` or ``skipped`` with
    the ETag it has now, and the size where the manifest holds sizes; what is absent on either side counts as
    unchanged. Unknown keys, failed ones and any other status are pending. Both sides come grouped by key, so
    the join adds no exchange of its own and a hot ETag is no hot join key.
    """
    settled = manifest.where(F.col("status").isin("done", "skipped"))
    now, then = current.alias("now"), settled.alias("then")
    same = F.lit(True)
    for c in ("etag", "size"):
        if c in current.columns and c in manifest.columns:
            same = same & F.coalesce(F.col(f"now.{c}") == F.col(f"then.{c}"), F.lit(True))
    return now.join(then, (F.col("now.item_key") == F.col("then.item_key")) & same, "left_anti").select(*[f"now.{c}" for c in current.columns])


def pending_keys(listing: DataFrame, log: DataFrame) -> DataFrame:
    """:func:`pending` over a raw object listing and a raw ingestion log."""
    return pending(current_listing(listing), folded_manifest(log)).select("item_key", "etag")


class IncrementalRun:
    """Crash-safe runs over a listing: plan, write by batch identifier, commit the manifest.

    ``root`` holds ``work/<seq>/`` (what the run of that number has to do), ``batches/<batch id>/`` (outputs) and
    ``manifest/<batch id>/`` (one parquet folder per committed run). A manifest folder counts only once it holds its
    ``_SUCCESS`` marker, which the file output committer writes last; that marker is the commit. Every ``compact_after``
    runs a folder ``manifest/<seq>-all/`` with the folded state is committed likewise, and what it covers is deleted: a run
    reads that many folders at most.
    """

    def __init__(self, spark: SparkSession, root: str, compact_after: int = 20):
        self.spark, self.root, self.compact_after = spark, root.rstrip("/"), compact_after

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def committed(self) -> list[str]:
        """Names of the committed manifest folders in force: the latest folded one and the batches after it."""
        fs, base = self._fs(), self._path("manifest")
        if not fs.exists(base):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(base))
        done = [n for n in names if fs.exists(self._path(f"manifest/{n}/_SUCCESS"))]
        folded = max((n for n in done if n.endswith("-all")), default="")
        # a folded folder bears the number of the last run in it
        return ([folded] if folded else []) + [n for n in done if not n.endswith("-all") and n[:6] > folded[:6]]

    def next_seq(self) -> int:
        """The number of the next run: one more than the last committed one."""
        done = self.committed()
        return int(done[-1][:6]) + 1 if done else 0

    def manifest(self) -> DataFrame:
        """``(item_key, etag, size, status)`` over all committed batches; the later batch wins."""
        return self._folded().drop("seq")

    def _folded(self) -> DataFrame:
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).parquet(*[f"{self.root}/manifest/{n}" for n in done])
        best = rows.groupBy("item_key").agg(F.max(F.struct("seq", "status", "etag", "size")).alias("m"))
        return best.select("item_key", "m.etag", "m.size", "m.status", "m.seq")

    def plan(self, listing: DataFrame) -> tuple[str, DataFrame]:
        """The batch identifier and the pending ``(item_key, etag, size)`` rows of the next run, read from its work list.

        ``listing`` has ``(key, etag, size, listed_at)``. It is read once, into the work list: what arrives afterwards is pending for the run after. The
        identifier depends only on the run's number and on which keys and ETags are pending, in any order: a repeated plan
        after a failure has the same one.
        """
        seq = self.next_seq()
        path = f"{self.root}/work/{seq:06d}"
        pending(current_listing(listing, size="size"), self.manifest()).write.mode("overwrite").parquet(path)
        todo = self.spark.read.schema("item_key string, etag string, size bigint").parquet(path)
        one = todo.select(F.xxhash64("item_key", "etag").alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x")).first()
        return f"{seq:06d}-{one['n']}-{(one['x'] or 0) & (2**64 - 1):016x}", todo

    def run(self, listing: DataFrame, process: Callable[[DataFrame], DataFrame]) -> str | None:
        """Process what is pending; returns the batch identifier, or None where nothing is.

        ``process`` takes ``(item_key, etag, size)`` and returns the output rows, with ``item_key``; an
        optional ``status`` column marks failed items, which stay pending. Keys that it returns no
        row for are recorded as ``skipped``; rows of other keys are left out of the manifest.
        """
        batch, todo = self.plan(listing)
        if batch.split("-")[1] == "0":
            return None
        out = f"{self.root}/batches/{batch}"
        result = process(todo)
        if "status" not in result.columns:
            result = result.withColumn("status", F.lit("done"))
        result.write.mode("overwrite").parquet(out)
        # an item fails if any of its rows does
        seen = self.spark.read.parquet(out).groupBy("item_key").agg(
            F.max(F.when(F.col("status") == "failed", "failed")).alias("bad"), F.min("status").alias("status")
        )
        seq = int(batch[:6])
        state = todo.join(seen, "item_key", "left").select(
            "item_key", "etag", "size", F.coalesce("bad", "status", F.lit("skipped")).alias("status"), F.lit(seq).cast("bigint").alias("seq")
        )
        state.write.mode("overwrite").parquet(f"{self.root}/manifest/{batch}")
        self._fs().delete(self._path(f"work/{seq:06d}"), True)
        if len(self.committed()) > self.compact_after:
            self.compact()
        return batch

    def compact(self) -> None:
        """Commit the folded state of all batches as one folder, then delete the folders that it covers.

        Dying before the commit leaves the batches in force, dying after it the folded folder, and the next call deletes the rest.
        """
        done = self.committed()
        if not done:
            return
        name = f"{done[-1][:6]}-all"
        if done != [name]:
            self._folded().write.mode("overwrite").parquet(f"{self.root}/manifest/{name}")
        fs = self._fs()
        for s in fs.listStatus(self._path("manifest")):
            old = s.getPath().getName()
            if old != name and old[:6] <= name[:6]:
                fs.delete(s.getPath(), True)

    def describe(self) -> str:
        return json.dumps({"root": self.root, "committed": self.committed()})
