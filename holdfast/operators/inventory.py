"""Inventory of an object listing: profiles by many dimensions, totals, percentiles, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.functions import scalars as S


def current_objects(listing: DataFrame) -> DataFrame:
    """``(bucket, key, size, etag, class, modified)``, one row for each bucket and key: the latest listed.

    Equal times: the greatest of the other columns. Rows without a key are left out.
    """
    rest = F.struct("listed_at", "size", "etag", "class", "modified")
    best = listing.where("key IS NOT NULL").groupBy("bucket", "key").agg(F.max(rest).alias("r"))
    return best.select("bucket", "key", "r.size", "r.etag", "r.class", "r.modified")


def described(objects: DataFrame) -> DataFrame:
    """Objects with every derived column; only those that a query uses are computed."""
    k = F.col("key")
    return objects.select(
        "bucket", "key", S.size_of(F.col("size")).alias("size"), S.bare(F.col("etag")).alias("etag"), S.storage_class(F.col("class")).alias("class"), "modified",
        S.extension(k).alias("ext"), S.content_type(k).alias("ctype"), S.material(k).alias("material"), S.is_noise(k).alias("noise"),
        S.top_prefix(k).alias("top"), S.prefix(k, 2).alias("prefix"), S.modified_year(F.col("modified")).alias("year"), F.lower(S.basename(k)).alias("name"),
    )


def top_k(df: DataFrame, k: int, by: list[Column], within: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows in a total order, or of each group; groups keep at most ``k`` rows before the exchange."""
    if not within:
        return df.orderBy(*by).limit(k)
    w = Window.partitionBy(*within).orderBy(*by)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


DIMENSIONS = ("ext", "ctype", "class", "top", "year", "material", "prefix")


def dimension_counts(objects: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``(bucket, dim, value, objects, bytes)`` for all dimensions in one scan and one exchange. NULL values don't count."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])
    each = described(objects).select("bucket", "size", F.explode(pairs).alias("p")).where("p.value IS NOT NULL")
    return each.groupBy("bucket", F.col("p.dim").alias("dim"), F.col("p.value").alias("value")).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def value_counts(objects: DataFrame, dim: str) -> DataFrame:
    """``(<dim>, objects, bytes)`` over all buckets."""
    return described(objects).where(F.col(dim).isNotNull()).groupBy(dim).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def corpus_totals(objects: DataFrame) -> DataFrame:
    """One row: objects and bytes without noise, documents, PDFs, and the noise beside them."""
    real = ~F.col("noise")
    n = lambda c: F.count_if(c)
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0))
    doc, pdf = real & (F.col("material") == "document"), real & (F.col("ext") == ".pdf")
    return described(objects).agg(
        n(real).alias("objects"), s(real).alias("bytes"), n(doc).alias("documents"), s(doc).alias("document_bytes"), n(pdf).alias("pdfs"),
        s(pdf).alias("pdf_bytes"), n(F.col("noise")).alias("noise_objects"), s(F.col("noise")).alias("noise_bytes"),
    )


def bucket_matrix(objects: DataFrame) -> DataFrame:
    """A row for each bucket with its counts by material, PDFs counted whether noise or not, and its size."""
    return described(objects).groupBy("bucket").agg(
        F.count("*").alias("objects"), F.sum("size").alias("bytes"),
        *[F.count_if(F.col("material") == m).alias(f"{m}_objects") for m in ("document", "web", "media", "other", "noise")],
        F.count_if(F.col("ext") == ".pdf").alias("pdfs"),
    )


def size_summary(objects: DataFrame, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """``(bucket, objects, bytes, mean, min, max, p50, p90, p99)``: whole means, and percentiles by nearest rank.

    The rank is ``round(p / 100 * (n - 1))``, halves to even. It is found in counts of distinct sizes, summed up
    in the order of size by range: first over ranges, then within the one range that holds the rank, so that
    no bucket's sizes are sorted in one task.
    """
    sized = objects.select("bucket", S.size_of(F.col("size")).alias("size"))
    per = sized.groupBy("bucket", "size").agg(F.count("*").alias("n"))
    # ranges are powers of two in eighths: at most some 500 for each bucket
    lg = F.when(F.col("size") <= 0, F.lit(-1)).otherwise(F.floor(F.log2(F.col("size").cast("double")) * 8)).cast("int")
    per = per.withColumn("range", lg)
    ranges = per.groupBy("bucket", "range").agg(F.sum("n").alias("rn"), F.sum(F.col("n") * F.col("size")).alias("rb"), F.min("size").alias("rmin"), F.max("size").alias("rmax"))
    whole = ranges.groupBy("bucket").agg(F.sum("rn").alias("objects"), F.sum("rb").alias("bytes"), F.min("rmin").alias("min"), F.max("rmax").alias("max"))
    before = F.sum("rn").over(Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranks = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.bround(F.lit(p) / F.lit(100) * (F.col("objects") - 1), 0).cast("bigint").alias("at")) for p in percents]))
    goal = whole.select("bucket", ranks.alias("r")).select("bucket", "r.p", "r.at")
    cum = ranges.select("bucket", "range", "rn", F.coalesce(before, F.lit(0)).alias("before"))
    hit = cum.join(goal, "bucket").where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("rn"))).select("bucket", "range", "p", (F.col("at") - F.col("before")).alias("at"))
    run = F.sum("n").over(Window.partitionBy("bucket", "range", "p").orderBy("size"))
    inner = per.join(hit, ["bucket", "range"]).withColumn("cum", run).where("cum > at")
    value = inner.groupBy("bucket", "p").agg(F.min("size").alias("v")).groupBy("bucket").agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])
    return whole.join(value, "bucket").select("bucket", "objects", "bytes", F.expr("bytes div objects").alias("mean"), "min", "max", *[f"p{p}" for p in percents])


def text_extractable(objects: DataFrame) -> DataFrame:
    """``(bucket, objects, extractable, extractable_share)``; the share has four decimals."""
    t = described(objects).groupBy("bucket").agg(F.count("*").alias("objects"), F.count_if(F.col("ctype").isin(*S.TEXT_TYPES)).alias("extractable"))
    return t.withColumn("extractable_share", F.round(S.share(F.col("extractable"), F.col("objects")), 4))


def zero_byte(objects: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` empty objects of each bucket by key, with the bucket's number of them."""
    empty = described(objects).where("size = 0")
    n = empty.groupBy("bucket").agg(F.count("*").alias("zero_byte_objects"))
    return top_k(empty.select("bucket", "key"), k, [F.col("key")], ["bucket"]).join(n, "bucket")


def archive_tier(objects: DataFrame) -> DataFrame:
    """``(bucket, archived)``: whether any object's class is an archive tier."""
    return described(objects).groupBy("bucket").agg(F.bool_or(F.col("class").rlike("GLACIER|DEEP")).alias("archived"))


def name_size_collisions(objects: DataFrame) -> DataFrame:
    """``(bucket, collision_groups)``: groups of objects, not empty, of one base name and size."""
    g = described(objects).where("size <> 0").groupBy("bucket", "name", "size").agg(F.count("*").alias("n")).where("n > 1")
    return g.groupBy("bucket").agg(F.count("*").alias("collision_groups"))


def etag_groups(objects: DataFrame, corpus: bool = True) -> DataFrame:
    """``(etag, copies, buckets)`` of content-hash ETags held by more than one object.

    ``corpus``: over all buckets, without noise and empty objects. Otherwise within each bucket (a column more), all objects.
    """
    d = described(objects).where(S.is_content_hash(F.col("etag")))
    if corpus:
        d = d.where("NOT noise AND size > 0")
        per = d.groupBy("etag", "bucket").agg(F.count("*").alias("n"))
        return per.groupBy("etag").agg(F.sum("n").alias("copies"), F.count("*").alias("buckets")).where("copies > 1")
    return d.groupBy("bucket", "etag").agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_totals(objects: DataFrame) -> DataFrame:
    """One row: identical groups, groups over several buckets, redundant objects."""
    g = etag_groups(objects)
    return g.agg(F.count("*").alias("identical_groups"), F.count_if(F.col("buckets") > 1).alias("cross_bucket_groups"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("redundant_objects"))


def listing_duplicates(objects: DataFrame) -> DataFrame:
    """``(bucket, identical_groups, redundant_objects)``, noise and empty objects included."""
    return etag_groups(objects, corpus=False).groupBy("bucket").agg(F.count("*").alias("identical_groups"), F.sum(F.col("copies") - 1).alias("redundant_objects"))


def largest_groups(objects: DataFrame, k: int = 25, members: int = 6) -> DataFrame:
    """``(etag, copies, buckets, keys)``: the largest groups with their first keys, joined by a line end.

    The first keys are ranked, not collected: a group never comes into one task whole.
    """
    top = top_k(etag_groups(objects), k, [F.desc("copies"), F.col("etag")])
    d = described(objects).where("NOT noise AND size > 0").select("etag", "bucket", "key")
    # k rows
    some = d.join(F.broadcast(top.select("etag")), "etag")
    first = top_k(some, members, [F.col("bucket"), F.col("key")], ["etag"])
    keys = first.groupBy("etag").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("::", "bucket", "key"))), "\n").alias("keys"))
    return top.join(keys, "etag")


def largest_listing_groups(objects: DataFrame, k: int = 10, members: int = 5) -> DataFrame:
    """``(bucket, etag, copies, keys)``: each listing's largest groups with their first keys, joined by a line end; noise and
    empty objects included. ``k`` groups a bucket are broadcast, as a registry bounds their number."""
    top = top_k(etag_groups(objects, corpus=False), k, [F.desc("copies"), F.col("etag")], ["bucket"])
    some = described(objects).select("bucket", "etag", "key").join(F.broadcast(top.select("bucket", "etag")), ["bucket", "etag"])
    first = top_k(some, members, [F.col("key")], ["bucket", "etag"])
    keys = first.groupBy("bucket", "etag").agg(F.array_join(F.array_sort(F.collect_list("key")), "\n").alias("keys"))
    return top.join(keys, ["bucket", "etag"]).select("bucket", "etag", "copies", "keys")


#: How many values of a dimension a listing's summary shows, NULL for all; years come in their own order.
SHOWN = {"ext": 25, "ctype": None, "class": None, "top": 40, "year": None, "material": None, "prefix": 25}


def listing_summary(objects: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """A row for each bucket: sizes, percentiles, what text can be taken from, empty objects, duplicates, and for each dimension its
    leading values as ``value=objects/bytes``, joined by a line end. With a registry its buckets' regions stand beside, and
    registered buckets without objects have a row of zeros."""
    d = dimension_counts(objects)
    rank = F.row_number().over(Window.partitionBy("bucket", "dim").orderBy(F.when(F.col("dim") == "year", F.col("value")), F.desc("objects"), "value"))
    most = F.lit(None).cast("int")
    for dim, k in SHOWN.items():
        most = F.when(F.col("dim") == dim, F.lit(k).cast("int")).otherwise(most)
    shown = d.withColumn("rank", rank).where(most.isNull() | (F.col("rank") <= most))
    line = F.struct("rank", F.concat(F.col("value"), F.lit("="), F.col("objects"), F.lit("/"), F.col("bytes")).alias("line"))
    listed = lambda dim: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("dim") == dim, line))), lambda x: x["line"]), "\n").alias(f"by_{dim}")
    dims = shown.groupBy("bucket").agg(*[listed(dim) for dim in SHOWN])
    empty = described(objects).where("size = 0").groupBy("bucket").agg(F.count("*").alias("zero_byte_objects"))
    out = size_summary(objects).join(text_extractable(objects).drop("objects"), "bucket").join(dims, "bucket")
    for part in (empty, name_size_collisions(objects), listing_duplicates(objects)):
        out = out.join(part, "bucket", "left")
    if registry is not None:
        r = registry.where("name IS NOT NULL").groupBy(F.col("name").alias("bucket")).agg(F.max("region").alias("region"))
        out = r.join(out, "bucket", "full")
    return out.na.fill(0).na.fill("", [f"by_{dim}" for dim in SHOWN])


def empty_listings(objects: DataFrame, registry: DataFrame) -> DataFrame:
    """``(bucket)`` of registered buckets without a listed object; raises where no listing holds anything."""
    held = objects.groupBy("bucket").agg(F.count("*").alias("objects"))
    guard = held.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.raise_error(F.lit("every listing is empty"))).otherwise(F.lit(True)).cast("boolean").alias("some"))
    r = registry.where("name IS NOT NULL").select(F.col("name").alias("bucket")).distinct()
    return r.join(held, "bucket", "left_anti").join(F.broadcast(guard)).where("some").select("bucket")  # one row


def stride_sample(objects: DataFrame, k: int = 50) -> DataFrame:
    """``k`` keys at equal steps through the listing's order, (bucket, key).

    Positions come from counts of ranges, so that the listing isn't numbered in one task.
    """
    rows = objects.select("bucket", "key")
    total = rows.count()
    step = max(1, total // k) if k else 1
    ranged = rows.repartitionByRange(max(1, min(2000, total // 100_000 + 1)), "bucket", "key").sortWithinPartitions("bucket", "key").withColumn("part", F.spark_partition_id())
    inner = ranged.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("bucket", "key")))
    sizes = {r["part"]: r["n"] for r in inner.groupBy("part").agg(F.count("*").alias("n")).collect()}
    at, base = 0, {}
    for p in sorted(sizes):
        base[p] = at
        at += sizes[p]
    shift = inner.sparkSession.createDataFrame([(p, b) for p, b in base.items()] or [(0, 0)], "part int, base bigint")
    placed = inner.join(F.broadcast(shift), "part").withColumn("pos", F.col("base") + F.col("rn") - 1)  # a row for each range
    return placed.where((F.col("pos") % step == 0) & (F.col("pos") < step * k)).select("pos", "bucket", "key")


def select_scope(registry: DataFrame, only: list[str] | None = None, undecided: bool = False, excluded: bool = False) -> DataFrame:
    """Registry rows in scope: those named, or those in scope with the undecided or excluded ones added by flag. Unknown names raise."""
    if only:
        known = {r["name"] for r in registry.where(F.col("name").isin(*only)).select("name").distinct().collect()}
        if missing := sorted(set(only) - known):
            raise ValueError(f"not in the registry: {', '.join(missing)}")
        return registry.where(F.col("name").isin(*only))
    keep = F.col("in_scope").eqNullSafe(F.lit(True))
    if undecided:
        keep = keep | F.col("in_scope").isNull()
    if excluded:
        keep = keep | F.col("in_scope").eqNullSafe(F.lit(False))
    return registry.where(keep)


def unknown_buckets(objects: DataFrame, registry: DataFrame) -> DataFrame:
    """Buckets that are listed but not registered, with their objects. The listing is reduced to its buckets first."""
    held = objects.groupBy("bucket").agg(F.count("*").alias("objects"))
    return held.join(registry.select(F.col("name").alias("bucket")).distinct(), "bucket", "left_anti")
