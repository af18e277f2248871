"""A paged remote listing as a Spark data source, batch and streaming.

Pages come from a fetcher named by ``fetcher`` as ``module:function``, called with the options and a token (None for
the first page), which returns ``(rows, next token or None)``. The default fetcher reads pages from files, for tests
and for listings that were fetched elsewhere. As a stream the token is the offset: a restarted query goes on where the
last committed page ended, so no page is listed twice and none is lost. Tokens are opaque strings.
"""

from __future__ import annotations

import importlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "bucket string, key string, size bigint, modified string, etag string, class string"


def file_pages(options: dict, token: str | None) -> tuple[list[dict], str | None]:
    """Pages ``<path>/page-<n>.json``, each a JSON array of listed objects; the token is the page's number."""
    n = int(token or 0)
    page = Path(options["path"]) / f"page-{n}.json"
    rows = json.loads(page.read_text()) if page.exists() else []
    return rows, str(n + 1) if (Path(options["path"]) / f"page-{n + 1}.json").exists() else None


def _page(options: dict, bucket: str, token: str | None) -> tuple[list[dict], str | None]:
    """A bucket's page at a token, and the token of the next one."""
    own = dict(options) | {"bucket": bucket, "path": options.get("path", "").replace("{bucket}", bucket)}
    return _fetcher(options)(own, token)


def _fetcher(options: dict):
    module, _, name = options.get("fetcher", "holdfast.sources.paged:file_pages").partition(":")
    return getattr(importlib.import_module(module), name)


def _row(bucket: str, o: dict) -> tuple:
    return bucket, o.get("Key"), o.get("Size"), o.get("Modified"), (o.get("ETag") or "").strip('"'), o.get("Class") or "STANDARD"


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        """One partition for each bucket: a bucket's pages follow each other by token."""
        return [InputPartition(b) for b in self.options["buckets"].split(",")]

    def read(self, partition):
        token = json.loads(self.options.get("tokens", "{}")).get(partition.value)
        while True:
            rows, token = _page(self.options, partition.value, token)
            for o in rows:
                yield _row(partition.value, o)
            if token is None:
                return


class _Stream(SimpleDataSourceStreamReader):
    """The offset holds each bucket's next token and whether its listing is complete; a read takes a page of each bucket."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.buckets = self.options["buckets"].split(",")
        self.tokens = json.loads(self.options.get("tokens", "{}"))

    def _start(self, offset: dict, bucket: str) -> dict:
        return offset.get(bucket) or {"token": self.tokens.get(bucket), "complete": False}

    def initialOffset(self):
        return {b: self._start({}, b) for b in self.buckets}

    def read(self, start):
        out, end = [], {}
        for b in self.buckets:
            end[b] = at = self._start(start, b)
            if not at["complete"]:
                rows, token = _page(self.options, b, at["token"])
                out += [_row(b, o) for o in rows]
                end[b] = {"token": token, "complete": token is None}
        return iter(out), end

    def readBetweenOffsets(self, start, end):
        for b in sorted(end):
            at = self._start(start, b)
            while at != end[b] and not at["complete"]:
                rows, token = _page(self.options, b, at["token"])
                for o in rows:
                    yield _row(b, o)
                at = {"token": token, "complete": token is None}


class PagedListing(DataSource):
    """``spark.dataSource.register(PagedListing)``, then ``spark.read.format("paged_listing")``; options ``buckets``,
    separated by commas, ``path`` with ``{bucket}`` in it, ``fetcher``, and ``tokens``, a JSON object of the buckets' first tokens."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def listing_actions(buckets: DataFrame, checkpoints: DataFrame, force: bool = False) -> DataFrame:
    """``(bucket, action, token, objects, bytes)`` of each bucket of ``(name)``: what a listing run does with it.

    A complete listing is left as it is (``skip``), one with a token goes on there with what is counted already (``resume``), any
    other begins (``start``). With ``force`` all that has a checkpoint begins anew (``restart``), its old listing being discarded.
    """
    c = checkpoints.select("bucket", "complete", "continuation_token", "object_count", "total_bytes")
    j = buckets.select(F.col("name").alias("bucket")).where("bucket IS NOT NULL").distinct().join(c, "bucket", "left")
    known = F.col("complete").isNotNull()
    again = F.when(F.col("complete"), "skip").when(F.nullif("continuation_token", F.lit("")).isNotNull(), "resume").otherwise("start")
    action = F.when(F.lit(force) & known, "restart").otherwise(F.coalesce(again, F.lit("start")))
    kept = lambda c: F.when(F.col("action").isin("skip", "resume"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    j = j.withColumn("action", action)
    return j.select("bucket", "action", F.when(F.col("action") == "resume", F.col("continuation_token")).alias("token"), kept("object_count").alias("objects"), kept("total_bytes").alias("bytes"))


def resumed_options(actions: DataFrame) -> dict[str, str]:
    """Options ``buckets`` and ``tokens`` of :class:`PagedListing` for a run by :func:`listing_actions`; one row for each bucket."""
    todo = [r for r in actions.where("action <> 'skip'").orderBy("bucket").collect()]
    return {"buckets": ",".join(r["bucket"] for r in todo), "tokens": json.dumps({r["bucket"]: r["token"] for r in todo if r["token"]})}


def listing_totals(checkpoints: DataFrame) -> DataFrame:
    """One row ``(buckets, objects, bytes, incomplete)``; ``incomplete`` names the buckets to be resumed, by name, with commas between."""
    return checkpoints.agg(
        F.count("*").alias("buckets"), F.coalesce(F.sum("object_count"), F.lit(0)).alias("objects"), F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("bytes"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.coalesce("complete", F.lit(False)), F.col("bucket")))), ",").alias("incomplete"),
    )
