"""Stratified samples of an object listing and weighted estimates from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.functions import scalars as S

NEEDS = ("needs_ocr", "sparse_text")
FAILED = ("corrupt", "encrypted", "timeout", "download_failed")


def ingestable(objects: DataFrame, exclusions: DataFrame | None = None, buckets: list[str] | None = None, ending: str = ".pdf") -> DataFrame:
    """``(bucket, key, size, stratum)`` of objects that are no noise and not empty, whose key has the ending and
    none of its bucket's excluded prefixes. ``exclusions`` is ``(bucket, prefix)``."""
    k = F.col("key")
    o = objects.select("bucket", "key", S.size_of(F.col("size")).alias("size")).where(F.lower(k).endswith(ending) & ~S.is_noise(k) & (F.col("size") != 0))
    if buckets:
        o = o.where(F.col("bucket").isin(*buckets))
    if exclusions is not None:
        x = exclusions.select(F.col("bucket").alias("xb"), F.col("prefix").alias("xp"))
        o = o.join(x, (F.col("bucket") == F.col("xb")) & F.col("key").startswith(F.col("xp")), "left_anti")
    return o.withColumn("stratum", S.stratum(F.col("size")))


def excluded_by_pattern(objects: DataFrame, pattern: str = "**/*.eml") -> DataFrame:
    """Objects whose key matches a glob: ``**`` spans slashes, ``*`` doesn't, case aside."""
    regex, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            regex, i = regex + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            regex, i = regex + ".*", i + 2
        else:
            c = pattern[i]
            regex, i = regex + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() else c), i + 1
    return objects.where(F.col("key").rlike(f"(?is)^{regex}$"))


def allocation(population: DataFrame, total: int, minimum: int) -> DataFrame:
    """``(stratum, population, sampled)``: in proportion, halves to even, at least ``minimum``, at most all."""
    n = population.groupBy("stratum").agg(F.count("*").alias("population"))
    whole = n.agg(F.sum("population").alias("whole"))
    part = F.bround(F.lit(total) * F.col("population") / F.col("whole"), 0).cast("bigint")
    # whole is one row
    return n.join(F.broadcast(whole)).select("stratum", "population", F.least("population", F.greatest(F.lit(minimum), part)).alias("sampled"))


def draw(population: DataFrame, allocated: DataFrame, seed: int) -> DataFrame:
    """Exactly ``sampled`` rows of each stratum, those with the least hash of seed, bucket and key.

    A stratum is cut by the hash's first digits, and only as many of its cuts are ranked as the sample can
    reach: the draw doesn't sort a stratum in one task, and doesn't depend on partitioning.
    """
    h = F.md5(F.concat_ws("\0", F.lit(str(seed)), "bucket", "key"))
    rows = population.withColumn("h", h).withColumn("cut", F.substring("h", 1, 3))
    sizes = rows.groupBy("stratum", "cut").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stratum").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = sizes.withColumn("before", before).join(allocated.select("stratum", "sampled"), "stratum").where("before < sampled").select("stratum", "cut", (F.col("sampled") - F.col("before")).alias("quota"))
    # at most 4,096 cuts for each stratum
    near = rows.join(F.broadcast(quota), ["stratum", "cut"])
    rank = F.row_number().over(Window.partitionBy("stratum", "cut").orderBy("h", "bucket", "key"))
    return near.withColumn("rn", rank).where("rn <= quota").select("bucket", "key", "size", "stratum")


def verdict(measured: DataFrame, max_mb: float = 200.0, low: float = 50.0, rich: float = 250.0) -> DataFrame:
    """``measured`` with ``verdict``: too large, the failure there was, or what the characters a page say.

    Columns: size, and those of ``failure`` (a verdict or NULL), pages, chars_per_page; NULL where not measured.
    """
    v = (
        F.when(F.col("size") > max_mb * 1_000_000, "skipped_too_large").when(F.col("failure").isNotNull(), F.col("failure")).when(F.coalesce("pages", F.lit(0)) == 0, "corrupt")
        .when(F.col("chars_per_page") < low, "needs_ocr").when(F.col("chars_per_page") < rich, "sparse_text").otherwise("text_layer")
    )
    return measured.withColumn("verdict", v)


def measure(files: DataFrame, fetch: Callable[[str, str], bytes], info: str = "pdfinfo", text: str = "pdftotext", max_mb: float = 200.0, pages_scanned: int = 30, info_seconds: int = 60, text_seconds: int = 180, tasks: int | None = None) -> DataFrame:
    """Runs two external tools on each file of ``(bucket, key, size)``; a row each, failures in ``failure``.

    ``fetch`` takes bucket and key and returns the file's bytes. Only names go through the plan: a file is fetched when its
    turn comes, one at a time, and handed to the tools' standard input; nothing is written to a disk. Files larger than
    ``max_mb`` aren't fetched. ``tasks`` spreads the files evenly.
    """

    def one(bucket: str, key: str, size: int | None) -> dict:
        import re
        import subprocess

        row = {"bucket": bucket, "key": key, "size": size, "failure": None, "pages": None, "producer": None, "chars_scanned": None, "chars_per_page": None, "error": None}
        if size is not None and size > max_mb * 1_000_000:
            return row
        try:
            content = fetch(bucket, key)
            i = subprocess.run([info, "-"], input=content, capture_output=True, timeout=info_seconds)
            if i.returncode:
                why = i.stderr.decode(errors="replace")
                return row | {"failure": "encrypted" if re.search("encrypt|password", why, re.I) else "corrupt", "error": why.strip()[:120]}
            said = i.stdout.decode(errors="replace")
            m, made = re.search(r"^Pages:\s*(\d+)", said, re.M), re.search(r"^Producer:[ \t]*(.*\S)", said, re.M)
            row |= {"pages": int(m[1]) if m else 0, "producer": made[1][:80] if made else None}
            if row["pages"]:
                n = min(row["pages"], pages_scanned)
                body = subprocess.run([text, "-l", str(n), "-", "-"], input=content, capture_output=True, timeout=text_seconds).stdout.decode(errors="replace")
                row["chars_scanned"] = len(re.sub(r"\s+", "", body))
                row["chars_per_page"] = round(row["chars_scanned"] / n, 1)
        except subprocess.TimeoutExpired:
            row["failure"] = "timeout"
        except Exception as e:  # whatever the fetcher or the system raises is one file's failure
            row |= {"failure": "download_failed", "error": str(e)[:120]}
        return row

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for b, k, s in zip(f.bucket, f.key, f["size"]):
                yield pd.DataFrame([one(b, k, None if pd.isna(s) else int(s))])

    named = files.select("bucket", "key", "size")
    return (named.repartition(tasks) if tasks else named).mapInPandas(run, "bucket string, key string, size bigint, failure string, pages bigint, producer string, chars_scanned bigint, chars_per_page double, error string")


def failed(results: DataFrame) -> DataFrame:
    """``(bucket, key, verdict)`` of files that couldn't be measured."""
    return results.where(F.col("verdict").isin(*FAILED)).select("bucket", "key", "verdict")


def top_producers(results: DataFrame, k: int = 12) -> DataFrame:
    """``(producer, files)``: the commonest producers, cut to 80 characters, ties by name."""
    p = results.where(F.col("producer") != "").groupBy(F.left("producer", F.lit(80)).alias("producer")).agg(F.count("*").alias("files"))
    return p.orderBy(F.desc("files"), "producer").limit(k)


def weights(allocated: DataFrame) -> DataFrame:
    """``(stratum, weight)`` of strata with a sample."""
    return allocated.where("sampled > 0").select("stratum", (F.col("population") / F.col("sampled")).alias("weight"))


def verdict_counts(results: DataFrame, allocated: DataFrame) -> DataFrame:
    """``(level, value, verdict, files, weighted)`` in one pass: over all, by stratum, and by bucket."""
    r = results.join(weights(allocated), "stratum", "left").na.fill(0.0, ["weight"])
    g = r.groupingSets([["verdict"], ["verdict", "stratum"], ["verdict", "bucket"]], "verdict", "stratum", "bucket").agg(F.grouping("stratum").alias("gs"), F.grouping("bucket").alias("gb"), F.count("*").alias("files"), F.sum("weight").alias("weighted"))
    level = F.when(F.col("gs") == 0, "stratum").when(F.col("gb") == 0, "bucket").otherwise("all")
    return g.select(level.alias("level"), F.coalesce("stratum", "bucket", F.lit("")).alias("value"), "verdict", "files", F.round("weighted", 6).alias("weighted"))


def page_statistics(results: DataFrame) -> DataFrame:
    """``(verdict, files, mean_pages, median_chars_per_page)`` of files with pages, by verdict and over ``all``."""
    m = results.where("pages > 0")
    return m.groupingSets([["verdict"], []], "verdict").agg(F.count("*").alias("files"), F.round(F.avg("pages"), 6).alias("mean_pages"), F.round(F.median("chars_per_page"), 6).alias("median_chars_per_page")).select(F.coalesce("verdict", F.lit("all")).alias("verdict"), "files", "mean_pages", "median_chars_per_page")


def estimate(results: DataFrame, allocated: DataFrame, usd_per_1000_pages: float = 1.5, seconds_per_page: float = 2.0) -> DataFrame:
    """One row of estimates: the weighted share that needs OCR with its standard error and 95 % interval,
    Horvitz-Thompson totals of pages, what they cost, and the naive product that overstates them."""
    need = F.col("verdict").isin(*NEEDS)
    r = results.join(weights(allocated), "stratum", "left").na.fill(0.0, ["weight"])
    t = r.agg(
        F.sum("weight").alias("w"), F.sum(F.when(need, F.col("weight")).otherwise(0.0)).alias("wn"),
        F.sum(F.when(need, F.col("weight") * F.coalesce("pages", F.lit(0))).otherwise(0.0)).alias("pn"),
        F.sum(F.when(F.col("pages") > 0, F.col("weight") * F.col("pages")).otherwise(0.0)).alias("pa"), F.avg(F.when(F.col("pages") > 0, F.col("pages"))).alias("mp"),
    )
    whole = allocated.agg(F.sum("population").alias("population"))
    p = results.groupBy("stratum").agg(F.count_if(need).alias("k"))
    ph = F.coalesce("k", F.lit(0)) / F.col("sampled")
    s = allocated.where("sampled >= 2").join(p, "stratum", "left").join(F.broadcast(whole.withColumnRenamed("population", "all")))
    var = s.agg(F.coalesce(F.sum(F.pow(F.col("population") / F.col("all"), 2) * ph * (1 - ph) / F.col("sampled")), F.lit(0.0)).alias("v"))
    j = t.join(whole).join(var)  # one row each
    share = F.coalesce(F.try_divide("wn", "w"), F.lit(0.0))
    se = F.sqrt("v")
    pages = F.floor(F.coalesce("pn", F.lit(0.0)) + 1e-6).cast("bigint")
    return j.select(
        "population", F.round(share, 6).alias("ocr_share"), F.round(se, 6).alias("std_error"),
        F.round(F.greatest(F.lit(0.0), share - 1.96 * se), 4).alias("ci_low"), F.round(F.least(F.lit(1.0), share + 1.96 * se), 4).alias("ci_high"),
        pages.alias("pages_needing_ocr"), F.floor(F.coalesce("pa", F.lit(0.0)) + 1e-6).cast("bigint").alias("corpus_pages"),
        F.round(F.col("population") * share * F.coalesce("mp", F.lit(0.0)), 2).alias("naive_pages"),
        F.round(pages / 1000 * usd_per_1000_pages, 2).alias("usd"), F.round(pages * seconds_per_page / 3600, 2).alias("core_hours"),
    )
