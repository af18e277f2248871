"""Near-duplicate records with small edits (problem 5).

Order MinHash: a text's k-mers of words are labelled with their occurrence number and hashed; in each
of many hash ranges the least ones are sampled and kept in their text order, so that a sketch is
sensitive to edit similarity, not only to the shared set. Texts that agree in sketches are candidates,
and candidates are verified on their whole texts: by the share of distinct k-mers they have in common,
exactly, and by a banded alignment of their k-mers.

Texts whose words are the same are one class before anything else, represented by its least id.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.batches import map_columns
from holdfast.operators.components import connected_components
from holdfast.operators.rows import join_counted, one_per_key
from holdfast.storage import small_enough, written

_MUL = np.uint64(0x9E3779B97F4A7C15)
_ZERO = np.zeros(1, np.int64)


#: Least k-mer hashes kept of a text, for a first estimate of a pair's similarity.
BOTTOM = 64


#: Passages: a salt, their mean length in k-mers, the least length that counts, and one in how many is kept, chosen by content. Long
#: ones find moved paragraphs, short ones moved sentences.
PASSAGES = ((0, 32, 6, 2), (7, 12, 5, 3))


class _WordHash(dict):
    """32-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of ``k`` words, in text order."""
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        h = h * _MUL + words[i : n + i] + np.uint64(1) if n > 0 else h
    return _mix(h)


def occurrence_labelled(h: np.ndarray) -> np.ndarray:
    """k-mer hashes with the number of the occurrence mixed in: repeats of a k-mer differ."""
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return h
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate((_ZERO == 0, s[1:] != s[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    out = h.copy()
    out[order] = _mix(s + (np.arange(len(s)) - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def _minima(v: np.ndarray, order: np.ndarray, part: np.ndarray, least: int, salt: np.ndarray | int) -> np.ndarray:
    """A sketch for each part with at least ``least`` k-mers: its smallest ones in text order.

    ``order`` sorts by part and hash, ``part`` is in that order; ``salt`` is mixed in, by part where it is an array.
    """
    starts = np.concatenate((_ZERO, np.flatnonzero(part[1:] != part[:-1]) + 1))
    ends = np.append(starts[1:], len(part))
    starts = starts[ends - starts >= least]
    idx = order[starts[:, None] + np.arange(least)]
    idx.sort(axis=1)
    rows = v[idx]
    sketch = np.zeros(len(starts), np.uint64) + (salt[starts] if isinstance(salt, np.ndarray) else np.uint64(salt))
    for j in range(least):  # sensitive to the order: an odd multiplier's powers
        sketch = sketch * _MUL + rows[:, j]
    sketch = _mix(sketch)
    return sketch


def order_min_hash(h: np.ndarray, most: int = 64, least: int = 4) -> np.ndarray:
    """Order-sensitive sketches of labelled k-mer hashes given in text order.

    A permutation's top bits cut the k-mers into ranges, by powers of two up to ``most``: as many as leave
    4 to 16 in each, at each of these cuts. Of two texts at least half alike neither has more than twice the
    other's k-mers, so they share a cut. Texts with few ranges take more permutations. Beside them go sketches of
    passages that begin at k-mers chosen by their hash, see :data:`PASSAGES`, each with a least k-mer of the whole text: passages that were moved keep theirs.
    """
    n = len(h)
    if n <= least:
        return _mix(np.sort(h)[:1]) if n else h
    out = []
    for turn in range(1 if n >= 256 else 2 if n >= 128 else 4):
        v = _mix(h + np.uint64((turn * 0x632BE59BD9B4E019 + 0x1F83D9ABFB41BD6B) & 0xFFFFFFFFFFFFFFFF))
        order = np.argsort(v)
        r = most
        while r >= 1:
            if 4 * r <= n and (n <= 16 * r or r == most) or r == 1 and n < 8:
                part = (v[order] >> np.uint64(32)) * np.uint64(r) >> np.uint64(32)
                out.append(_minima(v, order, part, least, part + np.uint64(r << 20)) + np.uint64(turn))
            r //= 2
    # with the text's least k-mer under permutations of their own, else sentences that many texts share would meet
    whole = [_mix(h + np.uint64(0xA54FF53A5F1D36F1 + j)).min() for j in range(2)]
    for salt, mean, short, one_in in PASSAGES if n >= 128 else ():
        v = _mix(h + np.uint64(0x3C6EF372FE94F82B + salt))
        passage = np.cumsum(v % np.uint64(mean) == 0)
        v = _mix(v)
        order = np.argsort(passage.astype(np.uint64) << np.uint64(40) | v >> np.uint64(24))
        found = _minima(v, order, passage[order], short, 0x51ED27 + salt)
        found = found[found % np.uint64(one_in) == 0]
        out += [_mix(found * _MUL + w) for w in whole]
    return np.concatenate(out)


def sketches(texts: DataFrame, k: int, min_words: int, most: int = 64, least: int = 4) -> DataFrame:
    """``(id, text_class, node, sketch, bottom, compared)`` of all texts, from ``(id, text)``. NULL counts as empty.

    ``text_class`` is a 128-bit hash of the words in hexadecimal digits, ``node`` 64 bits of it, ``bottom`` the
    :data:`BOTTOM` least hashes of the distinct k-mers. Texts of fewer than ``min_words`` words aren't ``compared``
    and have no sketch: they are only alike where their words are the same.
    """

    def run(ids, bodies):
        known = _WordHash()
        for i, t in zip(ids, bodies):
            w = (t or "").lower().split()
            name = xxhash.xxh3_128_hexdigest(" ".join(w))
            node = int(np.uint64(int(name[:16], 16)).view(np.int64))
            if len(w) < max(min_words, k):
                yield i, name, node, [], b"", False
                continue
            words = np.array(list(map(known.__getitem__, w)), np.uint64)
            runs = kmers(words, k)
            sketch = np.unique(order_min_hash(occurrence_labelled(runs), most, least)).view(np.int64)
            least_of_all = np.unique(_mix(runs) >> np.uint64(32))[:BOTTOM].astype(np.uint32)
            yield i, name, node, sketch.tolist(), least_of_all.tobytes(), True

    return map_columns(texts, run, "id string, text_class string, node bigint, sketch array<bigint>, bottom binary, compared boolean")


def banded_alignment(x: np.ndarray, y: np.ndarray, band: int = 200) -> float:
    """Share of the longer sequence's k-mers in the longest common chain within ``band`` of the diagonal.

    Labelled k-mers are distinct, so that the chain is the longest increasing run of their places.
    """
    n = max(len(x), len(y))
    if not n:
        return 1.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band + abs(len(x) - len(y))
    i, j = i[near], j[near]
    tails: list[int] = []
    for place in j[np.argsort(i)].tolist():
        at = bisect_left(tails, place)
        if at == len(tails):
            tails.append(place)
        else:
            tails[at] = place
    return len(tails) / n


def candidate_pairs(nodes: DataFrame, threshold: float, large: int = 64, max_broadcast_rows: int = 200_000) -> DataFrame:
    """``(a, b)``, a < b: texts that agree in at least two sketches, or in one of few, or in one of many texts.

    ``nodes`` is a written table of ``(node, sketch, bottom)``. Most buckets hold two texts and give their pair
    in the aggregation itself. Buckets of up to ``large`` texts give their pairs. A larger one holds texts that
    are alike in masses; it is cut into parts by hash, and every two parts meet in a block of their own, so that all its
    pairs are compared by their least hashes, and no bucket comes into one task.
    """
    each = nodes.select("node", F.explode("sketch").alias("s"))
    buckets = written(each.groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("x"), F.max("node").alias("y")).where("n > 1"), "buckets")
    more = buckets.where(f"n > 2 AND n <= {large}").select("s")  # no bucket of these is hot
    pairs = buckets.where("n = 2").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if not small_enough(more, 0):
        more = F.broadcast(more) if small_enough(more, max_broadcast_rows) else more
        few = written(each.join(more, "s").select("s", "node"), "members")
        both = few.alias("u").join(few.alias("w"), (F.col("u.s") == F.col("w.s")) & (F.col("u.node") < F.col("w.node")))
        pairs = pairs.union(both.select(F.col("u.node").alias("a"), F.col("w.node").alias("b")))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("common"))
    found = counted.where("common > 1").select("a", "b").union(_of_few(counted, nodes, max_broadcast_rows))
    crowded = buckets.where(f"n > {large}").select("s", "n")
    if small_enough(crowded, 0):
        return found
    many = join_counted(nodes.select("node", "bottom", F.explode("sketch").alias("s")), crowded, "s", "n", max_broadcast_rows=max_broadcast_rows)
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / large))).cast("bigint")
    met = many.withColumn("g", F.pmod(F.xxhash64("node"), parts)).select("s", "g", "node", "bottom", F.explode(F.sequence(F.lit(0), parts - 1)).alias("h"))
    blocks = met.select("s", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), "g", "node", "bottom")
    return found.union(_of_blocks(blocks.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j"), threshold)).distinct()


def _of_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """Pairs between the parts ``i`` and ``j`` of a bucket that :func:`_perhaps` might keep: at least as many least
    hashes are common as it asks for. Rows of a block come one after another; a block is some hundred texts at most."""
    bound = _bound(threshold)

    def alike(g: list, node: list, bottom: list) -> tuple[np.ndarray, np.ndarray]:
        g, node = np.array(g), np.array(node, np.int64)
        hashes = [np.frombuffer(x, np.uint32) for x in bottom]
        size = np.array([len(x) for x in hashes])
        _, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        shared = n > 1
        seen = np.zeros((len(node), int(shared.sum())), np.float32)
        keep = shared[at]
        seen[np.repeat(np.arange(len(node)), size)[keep], (np.cumsum(shared) - 1)[at][keep]] = 1
        one, two = np.flatnonzero(g == g.min()), np.flatnonzero(g == g.max())
        x, y = np.nonzero(seen[one] @ seen[two].T >= bound * np.maximum(size[one][:, None], size[two][None, :]))
        a, b = node[one[x]], node[two[y]]
        # within one part each pair comes in both orders
        once = a < b if len(one) == len(node) else a != b
        return np.minimum(a, b)[once], np.maximum(a, b)[once]

    def run(batches):
        key, g, node, bottom = None, [], [], []
        for batch in batches:
            out = []
            for s, i, j, part, n, low in zip(*[c.to_pylist() for c in batch.columns]):
                if (s, i, j) != key:
                    if len(node) > 1 and (key[1] == key[2] or len(set(g)) > 1):
                        out.append(alike(g, node, bottom))
                    key, g, node, bottom = (s, i, j), [], [], []
                g.append(part)
                node.append(n)
                bottom.append(low)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])
        if len(node) > 1 and (key[1] == key[2] or len(set(g)) > 1):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in alike(g, node, bottom)], names=["a", "b"])

    return blocks.mapInArrow(run, "a bigint, b bigint")


def _of_few(counted: DataFrame, nodes: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """Pairs with one sketch in common of texts that have fewer than 40."""
    short = written(nodes.where("size(sketch) < 40").select(F.col("node").alias("s")), "short")
    short = F.broadcast(short) if small_enough(short, max_broadcast_rows) else short
    return counted.where("common = 1").join(short, F.col("a") == F.col("s"), "left_semi").select("a", "b")


class NearDuplicates:
    """Near-duplicates among records, as written tables.

    ``members`` is ``(id, text_class, representative, copies, compared)`` of each record, ``pairs`` is
    ``(id_a, id_b, similarity, edit_similarity)`` between representatives of at least ``min_words`` words. Rows without
    an id are left out; of rows with the same id one counts. NULL texts count as empty; all without a word are copies.
    """

    def __init__(self, records: DataFrame, k: int = 5, threshold: float = 0.8, min_words: int = 5, id_col: str = "id", text_col: str = "body_text", newest: str = "capture_date", max_broadcast_rows: int = 200_000, large: int = 64):
        rows = one_per_key(records.select(id_col, text_col, newest), id_col, newest)
        texts = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
        sketched = written(sketches(texts, k, min_words), "sketches")
        classes = sketched.groupBy("text_class").agg(F.min("id").alias("representative"), F.count("*").alias("copies"))
        repeated = written(classes.where("copies > 1"), "copies")
        # narrow rows alone go through the join by class, of which one may be hot; sketches meet only ids
        narrow = join_counted(sketched.select("id", "text_class", "compared"), repeated, "text_class", "copies", "left", max_broadcast_rows)
        self.members = narrow.select("id", "text_class", F.coalesce("representative", "id").alias("representative"), F.coalesce("copies", F.lit(1)).alias("copies"), "compared")
        copies = written(narrow.where("id <> representative").select("id"), "copies")
        copies = F.broadcast(copies) if small_enough(copies, max_broadcast_rows) else copies
        reps = sketched.where("compared").join(copies, "id", "left_anti")
        pairs = candidate_pairs(reps.select("node", "sketch", "bottom"), threshold, large, max_broadcast_rows)
        ids = reps.select("node", "id", "bottom")
        one = pairs.join(ids.select(F.col("node").alias("a"), F.col("id").alias("id_a"), F.col("bottom").alias("ba")), "a")
        named = one.join(ids.select(F.col("node").alias("b"), F.col("id").alias("id_b"), F.col("bottom").alias("bb")), "b").where("id_a <> id_b")
        named = written(_perhaps(named.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "ba", "bb"), threshold).distinct(), "candidates")
        wanted = written(named.select(F.col("id_a").alias("w")).union(named.select(F.col("id_b").alias("w"))).distinct(), "wanted")
        wanted = F.broadcast(wanted) if small_enough(wanted, max_broadcast_rows) else wanted
        whole = texts.join(wanted, F.col("id") == F.col("w"), "left_semi")
        words = _word_hashes(whole)
        one = named.join(words.select(F.col("id").alias("id_a"), F.col("words").alias("wa")), "id_a")
        both = one.join(words.select(F.col("id").alias("id_b"), F.col("words").alias("wb")), "id_b")
        self.pairs = written(_verified(both.select("id_a", "id_b", "wa", "wb"), k, threshold), "pairs")

    def groups(self) -> DataFrame:
        """``(record_id, group_id, links)``, one row for each record: the least id among what it is linked to, by way
        of others too, and the number of different texts it is directly linked to."""
        parts = connected_components(self.pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
        links = self.pairs.select(F.col("id_a").alias("n")).union(self.pairs.select(F.col("id_b").alias("n"))).groupBy("n").agg(F.count("*").alias("links"))
        named = parts.join(links, F.col("node") == F.col("n"), "left").select("node", "component", "links")
        m = self.members.join(named, F.col("representative") == F.col("node"), "left")
        return m.select(F.col("id").alias("record_id"), F.coalesce("component", "representative").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))

    def aligned(self, least: float = 0.5) -> DataFrame:
        """``(id_a, id_b, similarity, edit_similarity)`` between representatives whose k-mers also align: the longest chain of common
        k-mers in the order of both, within a band of the diagonal, is at least ``least`` of the longer text's. Reordered texts aren't among them."""
        return self.pairs.where(F.col("edit_similarity") >= least).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"), F.round("edit_similarity", 6).alias("edit_similarity"))

    def all_pairs(self, max_copies: int = 64) -> DataFrame:
        """``(id_a, id_b)``, id_a < id_b, between records of at least ``min_words`` words. Of a text with more than ``max_copies`` copies the
        representative stands for all in pairs with other texts, and each copy is paired with it."""
        some = self.members.where(f"compared AND copies > 1 AND copies <= {max_copies}").select("representative", "id")
        mass = self.members.where(f"compared AND copies > {max_copies} AND id <> representative").select(F.col("representative").alias("id_a"), F.col("id").alias("id_b"))
        within = some.alias("u").join(some.alias("w"), (F.col("u.representative") == F.col("w.representative")) & (F.col("u.id") < F.col("w.id"))).select(F.col("u.id").alias("id_a"), F.col("w.id").alias("id_b"))
        a = self.pairs.join(some.select(F.col("representative").alias("ra"), F.col("id").alias("a")), F.col("id_a") == F.col("ra"), "left").select(F.coalesce("a", "id_a").alias("id_a"), "id_b")
        b = a.join(some.select(F.col("representative").alias("rb"), F.col("id").alias("b")), F.col("id_b") == F.col("rb"), "left").select("id_a", F.coalesce("b", "id_b").alias("id_b"))
        every = within.union(mass).union(b)
        return every.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def _bound(threshold: float) -> float:
    """Four standard errors below ``threshold``, for an estimate from the least hashes."""
    return threshold - 4 * (threshold * (1 - threshold) / BOTTOM) ** 0.5


def _perhaps(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose least hashes don't rule out ``threshold``: the estimate is within four standard errors of it."""
    bound = _bound(threshold)

    def run(ids_a, ids_b, bottoms_a, bottoms_b):
        for a, b, x, y in zip(ids_a, ids_b, bottoms_a, bottoms_b):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            least = np.union1d(x, y)[: max(len(x), len(y))]
            both = np.intersect1d(np.intersect1d(x, y, assume_unique=True), least, assume_unique=True)
            if len(both) >= bound * len(least):
                yield a, b

    return map_columns(pairs, run, "id_a string, id_b string")


def _word_hashes(texts: DataFrame) -> DataFrame:
    """``(id, words)`` with the 32-bit hashes of a text's words as bytes."""

    def run(ids, bodies):
        known = _WordHash()
        for i, t in zip(ids, bodies):
            w = t.lower().split()
            yield i, np.array(list(map(known.__getitem__, w)), np.uint32).tobytes()

    return map_columns(texts, run, "id string, words binary")


def _verified(pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs at least ``threshold`` alike by distinct k-mers, with the alignment's share."""

    def run(ids_a, ids_b, words_a, words_b):
        for a, b, x, y in zip(ids_a, ids_b, words_a, words_b):
            x, y = (kmers(np.frombuffer(w, np.uint32).astype(np.uint64), k) for w in (x, y))
            u, w = np.unique(x), np.unique(y)
            both = len(np.intersect1d(u, w, assume_unique=True))
            alike = both / max(1, len(u) + len(w) - both)
            if alike >= threshold:
                yield a, b, alike, banded_alignment(occurrence_labelled(x), occurrence_labelled(y))

    return map_columns(pairs, run, "id_a string, id_b string, similarity double, edit_similarity double")


def near_duplicate_pairs(records: DataFrame) -> DataFrame:
    """``(id_a, id_b)`` of records of 50 words or more sharing at least half of their distinct three-word runs."""
    return NearDuplicates(records, k=3, threshold=0.5, min_words=50).all_pairs()
