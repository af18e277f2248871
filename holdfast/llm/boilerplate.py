"""Lines repeated across one site's documents (problem 4).

The lines of a site form a weighted graph: nodes are lines, weighted by the number of records they
stand in, edges join lines that follow each other, weighted likewise. High-support nodes and edges are
kept, the connected components of what remains are boilerplate blocks, and matching occurrences are deleted.
All of it runs in the JVM on 64-bit hashes of normalised lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.components import connected_components
from holdfast.operators.rows import join_counted, one_per_key
from holdfast.storage import small_enough, written


def normal_lines(text: Column) -> Column:
    """The lines of a text, lower-cased, without the digits 0-9, white space made single spaces and trimmed."""
    flat = F.translate(F.lower(text), "\t\r\f0123456789", "   ")
    return F.transform(F.split(F.regexp_replace(flat, " {2,}", " "), "\n"), lambda x: F.trim(x))


def _hashes(text: Column) -> Column:
    """64-bit hashes of a text's normalised lines, 0 for those without a letter."""
    return F.transform(normal_lines(text), lambda x: F.when(x.rlike(r"\p{L}"), F.xxhash64(x)).otherwise(F.lit(0).cast("bigint")))


def line_table(records: DataFrame, id_col: str = "id", site_col: str = "source_site", text_col: str = "body_text") -> DataFrame:
    """``(record_id, site, lines)`` with ``lines`` an array of 64-bit hashes, 0 for lines without a letter."""
    rows = records.select(F.col(id_col).cast("string").alias("record_id"), F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    return rows.where("record_id IS NOT NULL AND site IS NOT NULL AND length(text) > 0").select("record_id", "site", _hashes(F.col("text")).alias("lines"))


def line_support(lines: DataFrame) -> DataFrame:
    """``(site, line, n)``: the number of records of a site that a line stands in; combined map-side, by site and line."""
    each = lines.select("site", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
    return each.groupBy("site", "line").agg(F.count("*").alias("n"))


def high_support(support: DataFrame, sites: DataFrame, least_records: int = 8, least_share: float = 0.10) -> DataFrame:
    """Lines in at least ``least_records`` records and at least ``least_share`` of their site's records.

    A site has at most (mean lines of a record) / ``least_share`` of them. ``sites`` is ``(site, records)``.
    """
    often = support.where(F.col("n") >= least_records)
    return often.join(sites, "site").where(F.col("n") >= F.col("records") * F.lit(least_share)).select("site", "line", "n", "records")


class Boilerplate:
    """Boilerplate blocks of each site, held as a written table, and what follows from them.

    Records come once per id. Rows without an id or a site, and NULL or empty texts, have no lines; they
    do count as records of their site where they have an id.
    """

    def __init__(self, records: DataFrame, least_records: int = 8, least_share: float = 0.10, least_edge: float = 0.5, id_col: str = "id", site_col: str = "source_site", text_col: str = "body_text", newest: str = "capture_date", max_broadcast_rows: int = 500_000):
        kept = records.select(id_col, site_col, text_col, newest)
        self.records = one_per_key(kept, id_col, newest)
        self.id_col, self.site_col, self.text_col = id_col, site_col, text_col
        self.least_records, self.least_share, self.least_edge, self.max_broadcast_rows = least_records, least_share, least_edge, max_broadcast_rows
        self.lines = written(line_table(self.records, id_col, site_col, text_col), "hashes")
        sites = self.records.where(F.col(site_col).isNotNull()).groupBy(F.col(site_col).alias("site")).agg(F.count("*").alias("records"))
        self.nodes = written(high_support(line_support(self.lines), sites, least_records, least_share), "lines")
        self.members = written(self._components(), "blocks")

    def edges(self) -> DataFrame:
        """``(site, a, b, n)``: high-support lines that follow each other, blank lines aside, in at least
        ``least_edge`` of the records of the rarer one."""
        seq = F.filter("lines", lambda x: x != 0)
        pairs = self.lines.select("record_id", "site", seq.alias("s")).where("size(s) > 1").select(
            "site", F.explode(F.array_distinct(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("a"), F.slice("s", 2, F.size("s") - 1).alias("b")))).alias("p")
        ).select("site", "p.a", "p.b")
        one = self.nodes.select("site", F.col("line").alias("a"), F.col("n").alias("na"))
        two = self.nodes.select("site", F.col("line").alias("b"), F.col("n").alias("nb"))
        kept = join_counted(join_counted(pairs, one, ["site", "a"], "na", max_broadcast_rows=self.max_broadcast_rows), two, ["site", "b"], "nb", max_broadcast_rows=self.max_broadcast_rows)
        n = kept.groupBy("site", "a", "b").agg(F.count("*").alias("n"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        return n.where(F.col("n") >= F.greatest(F.lit(self.least_records), F.least("na", "nb") * F.lit(self.least_edge))).select("site", "a", "b", "n")

    def _components(self) -> DataFrame:
        """``(site, line, n, block)``: the high-support lines with the least line of their component, their own where no edge holds them."""
        name = lambda c: F.concat_ws("\x1f", F.col("site"), F.hex(F.col(c)))
        parts = connected_components(self.edges().select(name("a").alias("src"), name("b").alias("dst")))
        nodes = self.nodes.select("site", "line", "n", name("line").alias("node"))
        labelled = nodes.join(parts, "node", "left").select("site", "line", "n", F.coalesce("component", "node").alias("component"))
        least = labelled.groupBy("site", "component").agg(F.min("line").alias("block"))
        return labelled.join(least, ["site", "component"]).select("site", "line", "n", "block")

    def blocks(self) -> DataFrame:
        """``(site, block, lines, records)``: connected components of high-support lines; ``block`` is the least
        line hash of the component, ``records`` the greatest support among its lines."""
        return self.members.groupBy("site", "block").agg(F.count("*").alias("lines"), F.max("n").alias("records"))

    def occurrences(self) -> DataFrame:
        """``(record_id, line_no, site, line, block)`` of the blocks' lines wherever they stand, numbered from 1."""
        each = self.lines.select("record_id", "site", F.posexplode("lines").alias("pos", "line")).where("line <> 0")
        hit = join_counted(each, self.members, ["site", "line"], "n", max_broadcast_rows=self.max_broadcast_rows)
        return hit.select("record_id", (F.col("pos") + 1).cast("int").alias("line_no"), "site", "line", "block")

    def cleaned(self) -> DataFrame:
        """``(record_id, source_site, clean_text, removed)``: each record without the occurrences of blocks.

        Texts that hold none come out as they are; NULL ones as NULL.
        """
        rows = self.records.select(
            F.col(self.id_col).cast("string").alias("record_id"), F.col(self.site_col).alias("source_site"), F.col(self.text_col).alias("text")
        )
        raw = F.split(F.col("text"), "\n")
        if small_enough(self.members, self.max_broadcast_rows):
            per_site = self.members.groupBy("site").agg(F.collect_set("line").alias("bad"))  # bounded per site, see high_support
            joined = rows.join(F.broadcast(per_site), rows["source_site"] == per_site["site"], "left")
            pairs = F.arrays_zip(raw.alias("raw"), _hashes(F.col("text")).alias("h"))
            keep = F.transform(F.filter(pairs, lambda p: ~F.array_contains(F.col("bad"), p["h"])), lambda p: p["raw"])
        else:
            at = self.occurrences().groupBy("record_id").agg(F.collect_set("line_no").alias("bad"))  # no more than a record's own lines
            joined = rows.join(at, "record_id", "left")
            keep = F.filter(raw, lambda x, i: ~F.array_contains(F.col("bad"), i + 1))
        none = F.col("bad").isNull() | F.col("text").isNull()
        text = F.when(none, F.col("text")).otherwise(F.array_join(keep, "\n"))
        return joined.select("record_id", "source_site", text.alias("clean_text"), F.when(none, F.lit(0)).otherwise(F.size(raw) - F.size(keep)).alias("removed"))


def repeated_lines(records: DataFrame) -> DataFrame:
    """``(record_id, line_no)`` of lines that recur excessively within their site: the occurrences of its boilerplate blocks."""
    return Boilerplate(records).occurrences().select("record_id", "line_no").distinct()
