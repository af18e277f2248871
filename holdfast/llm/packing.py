"""Filling fixed-capacity containers with items (problem 8).

Conflict-constrained best fit: open bins are ordered by residual and carry bitmaps of the sources and
duplicate clusters in them; an item goes to the tightest bin that it fits and doesn't conflict with, found by
successor search. Items are dealt to shards by hash, each large enough to fill well and small enough for one task,
however many documents there are or share a source; what a shard leaves poorly filled is packed again with
others' leavings.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tokens import VOCABULARY, sized
from holdfast.storage import written

SCHEMA = "container_id string, doc_id bigint, token_start bigint, token_end bigint, tokens bigint"


def best_fit(items: Iterable[tuple[int, str, int, int]], capacity: int, separate_sources: bool = False) -> list[list[int]]:
    """Bins as lists of item numbers. Items are ``(size, order key, source bit, cluster bit)``, a bit being an
    integer of one bit, or 0 for none; sizes are at most ``capacity``.

    Larger items come first, equal ones by their key. Two items of a cluster never share a bin, nor, where
    ``separate_sources`` is set, do two of a source.
    """
    order = sorted((-size, key, n, s, c) for n, (size, key, s, c) in enumerate(items))
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ordered
    bins: list[list[int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    for size, _, n, s, c in order:
        size = -size
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (clusters[b] & c) and not (separate_sources and sources[b] & s):
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
            bins[b].append(n)
        else:
            residual, b = capacity, len(bins)
            bins.append([n])
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        if residual > size:
            insort(open_bins, (residual - size, b))
    return bins


def _pack(rows: list[tuple[int, str, str, int, int]], capacity: int, separate_sources: bool) -> list[list[tuple[int, str, str, int, int]]]:
    """Bins of ``(doc_id, source, text_key, start, end)``. Only what recurs needs a bit."""
    seen: dict[str, int] = {}
    for r in rows:
        seen[r[2]] = seen.get(r[2], 0) + 1
    bits: dict[str, int] = {}
    for k, n in seen.items():
        if n > 1:
            bits[k] = 1 << len(bits)
    named: dict[str, int] = {}
    if separate_sources:
        for r in rows:
            if r[1] is not None:
                named.setdefault(r[1], 1 << len(named))
    items = ((e - a, f"{k}{d:020d}{a:012d}", named.get(s, 0), bits.get(k, 0)) for d, s, k, a, e in rows)
    return [[rows[n] for n in b] for b in best_fit(items, capacity, separate_sources)]


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY, clusters: DataFrame | None = None) -> DataFrame:
    """``(doc_id, source, text_key, tokens)`` of documents with an id and tokens, a written table for :func:`pack`.

    ``text_key`` names a document's duplicate cluster: that of its exact copies, or that of ``clusters``, ``(doc_id, cluster)``
    with one row for each id, where it has one there.
    """
    base = sized(documents, vocabulary)
    if clusters is not None:
        named = clusters.select("doc_id", F.col("cluster").cast("string").alias("cluster")).where("doc_id IS NOT NULL")
        base = base.join(named, "doc_id", "left").select("doc_id", "source", F.coalesce(F.concat(F.lit("c"), "cluster"), "text_key").alias("text_key"), "tokens")
    return written(base, "tokens")


def pack(documents: DataFrame, capacity: int, separate_sources: bool = False, vocabulary: str = VOCABULARY, shard_tokens: int = 4_000_000, well_filled: float = 0.97, clusters: DataFrame | None = None) -> DataFrame:
    """``(container_id, doc_id, token_start, token_end, tokens)``: every token of every document in one container.

    Documents over the capacity are split into full containers and a rest; no others are. A container holds no two documents of a
    duplicate cluster, see :func:`sizes`. Documents without an id or without tokens are left out. Bins filled below
    ``well_filled`` are taken apart and packed once more, a sixteenth as many shards sharing them.
    """
    return pack_sized(sizes(documents, vocabulary, clusters), capacity, separate_sources, shard_tokens, well_filled)


def pack_profiles(documents: DataFrame, profiles: DataFrame, most: int = 1000, **options) -> DataFrame:
    """:func:`pack` for each row of ``(profile, capacity_tokens)``, with ``profile`` as first column; texts are sized once.

    The profiles are a given small table; more than ``most`` raise. Profiles without a positive capacity are left out.
    """
    rows = profiles.where("capacity_tokens > 0").select("profile", "capacity_tokens").distinct().orderBy("capacity_tokens", "profile").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} profiles")
    base = sizes(documents, options.pop("vocabulary", VOCABULARY), options.pop("clusters", None))
    out = base.where("false").select(F.lit("").alias("profile"), F.lit("").alias("container_id"), "doc_id", F.col("tokens").alias("token_start"), F.col("tokens").alias("token_end"), "tokens")
    for r in rows:
        out = out.union(pack_sized(base, r["capacity_tokens"], **options).select(F.lit(r["profile"]).alias("profile"), "*"))
    return out


def pack_sized(base: DataFrame, capacity: int, separate_sources: bool = False, shard_tokens: int = 4_000_000, well_filled: float = 0.97) -> DataFrame:
    """:func:`pack` of a written table of :func:`sizes`."""
    if capacity < 1:
        raise ValueError("a container holds at least one token")
    total = base.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    size = F.lit(capacity).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, size)
    pieces = base.select("doc_id", "source", "text_key", "tokens", F.explode(starts).alias("a")).select("doc_id", "source", "text_key", "a", F.least("tokens", F.col("a") + size).alias("e"))
    whole = pieces.where(F.col("e") - F.col("a") == capacity).select(F.concat_ws("-", F.lit("w"), "doc_id", "a").alias("container_id"), "doc_id", F.col("a").alias("token_start"), F.col("e").alias("token_end"), (F.col("e") - F.col("a")).alias("tokens"))
    rest = pieces.where(F.col("e") - F.col("a") < capacity)
    first = written(_packed(rest, shards, capacity, separate_sources, "a"), "bins")
    fill = first.groupBy("container_id").agg(F.sum(F.col("e") - F.col("a")).alias("n"))
    poor = fill.where(F.col("n") < well_filled * capacity).select("container_id")
    again = first.join(poor, "container_id", "left_semi").select("doc_id", "source", "text_key", "a", "e")
    second = _packed(again, max(1, shards // 16), capacity, separate_sources, "b")
    kept = first.join(poor, "container_id", "left_anti").union(second)
    return whole.union(kept.select("container_id", "doc_id", F.col("a").alias("token_start"), F.col("e").alias("token_end"), (F.col("e") - F.col("a")).alias("tokens")))


def _packed(pieces: DataFrame, shards: int, capacity: int, separate_sources: bool, label: str) -> DataFrame:
    schema = "container_id string, doc_id bigint, source string, text_key string, a bigint, e bigint"

    def run(key, frames):
        import pandas as pd

        rows: list[tuple] = []
        for f in frames:
            rows += zip(f.doc_id.tolist(), [None if s is None or s != s else s for s in f.source.tolist()], f.text_key.tolist(), f.a.tolist(), f.e.tolist())
        out = [(f"{label}{key[0]}-{n}", *r) for n, b in enumerate(_pack(rows, capacity, separate_sources)) for r in b]
        yield pd.DataFrame(out, columns=["container_id", "doc_id", "source", "text_key", "a", "e"])

    shard = F.pmod(F.xxhash64("doc_id", "a", F.lit(label)), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(lambda k, f: next(run(k, [f])), schema)


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """``(container_id, pieces, tokens, unused)`` of each container."""
    return packed.groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens")).withColumn("unused", F.lit(capacity) - F.col("tokens"))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row ``(containers, pieces, tokens, unused_share)``; no row's worth of containers gives a share of 0."""
    c = containers(packed, capacity)
    return c.agg(F.count("*").alias("containers"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("unused") / (F.count("*") * F.lit(capacity)), F.lit(0.0)), 6).alias("unused_share"))


def fill_by_profile(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(profile, containers, pieces, tokens, unused_share)`` of :func:`pack_profiles`, a row for each profile with a capacity."""
    capacity = profiles.where("capacity_tokens > 0").select("profile", "capacity_tokens").distinct()
    c = packed.groupBy("profile", "container_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).groupBy("profile").agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"))
    j = F.broadcast(capacity).join(c, "profile", "left").na.fill(0, ["containers", "pieces", "tokens"])  # a given small table
    unused = F.lit(1.0) - F.coalesce(F.try_divide(F.col("tokens"), F.col("containers") * F.col("capacity_tokens")), F.lit(1.0))
    return j.select("profile", "containers", "pieces", "tokens", F.round(unused, 6).alias("unused_share"))
