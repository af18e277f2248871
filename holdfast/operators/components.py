"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.storage import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)``: every node of an edge with the least node of its component.

    Alternating star contraction: each round links all of a node's greater neighbours to its least
    one, then all smaller ones, until nothing changes; rounds grow with the logarithm of a component's
    length. Every step is a grouped minimum with map-side combining, so a node with many edges is no
    hot task. Each round is written to the shared folder, which cuts the lineage. NULLs are left out.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    e = written(e, "edges")
    last = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: greater neighbours go to the least one
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        # small star: a node and its smaller neighbours go to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), "m").union(low.select(F.col("a").alias("x"), "m"))
        e = written(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "small-star")
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if (state["n"], state["h"]) == last:
            break
        last = (state["n"], state["h"])
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
