"""Mixing sources to target weights (problem 9).

Temperature mixing: the weights go from the sources' own token shares to the target shares along an
exponent that is bisected to the largest one whose repetition limits hold for the wanted total, or, without
targets, to the one whose weights have a wanted entropy. Weights are realised as budgeted block permutations: a source's
texts are put in the order of a seeded hash, whole passes over them are counted, and the last pass ends at the budget,
found block by block, then by the blocks of the block that holds it, and text by text within one of these.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.tokens import VOCABULARY, sized
from holdfast.storage import written

#: Blocks that a source's hash order is cut into; the boundary block is cut into as many again, so that of a billion texts some
#: thousand are ordered text by text.
BLOCKS = 1024


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def _normal(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {s: w / total for s, w in weights.items()} if total else {}


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and normalised; sources without tokens get none."""
    return _normal({s: q**exponent for s, q in shares.items() if q > 0})


def exponent_for_entropy(shares: dict[str, float], wanted: float, steps: int = 60) -> float:
    """The exponent in [0, 4] whose tempered shares have the wanted entropy, or the end nearest to it."""
    lo, hi = 0.0, 4.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        if entropy(tempered(shares, mid)) > wanted:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def blended(shares: dict[str, float], targets: dict[str, float], exponent: float) -> dict[str, float]:
    """``shares ** (1 - exponent) * targets ** exponent``, normalised: 1 gives the targets, 0 the sources' own shares."""
    return _normal({s: q ** (1 - exponent) * targets[s] ** exponent for s, q in shares.items() if q > 0 and targets.get(s, 0) > 0})


def largest_total(tokens: dict[str, int], weights: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest total at which no source is repeated beyond its limit."""
    return min((tokens[s] * repeats[s] / w for s, w in weights.items() if w > 0), default=0.0)


def weights_for(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: float | None = None, steps: int = 60) -> tuple[dict[str, float], float, float]:
    """Weights, exponent and total. Without a total it is the largest at which the targets hold exactly (exponent 1);
    with one, the exponent is the largest at which the limits hold, down to 0; what then still exceeds a limit is cut by it.
    """
    whole = sum(tokens.values())
    shares = {s: n / whole for s, n in tokens.items()} if whole else {}
    goal = blended(shares, targets, 1.0)
    most = largest_total(tokens, goal, repeats)
    if total is None or total <= most:
        return goal, 1.0, most if total is None else total
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        if largest_total(tokens, blended(shares, targets, mid), repeats) >= total:
            lo = mid
        else:
            hi = mid
    return blended(shares, targets, lo), lo, total


def texts_once(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens)``: each text once, under the least id among its copies whose source has a target."""
    base = sized(documents, vocabulary)
    known = F.broadcast(targets.where("source IS NOT NULL AND target_share > 0").select("source").distinct())  # a given fixed table
    return base.join(known, "source", "left_semi").groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("r")).select("r.*")


class Mix:
    """A mix of ``documents`` by the table of targets ``(source, target_share, max_repeats)``.

    Rows with a NULL source, a source without a target, no id or no tokens aren't used. Sources without texts have
    no share, the others' targets being raised in proportion. ``plan`` and ``report`` read one written table of sizes.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: float | str | None = None, entropy_of_targets: bool = False, seed: int = 0, vocabulary: str = VOCABULARY):
        """``total`` is a number of tokens, ``"all"`` for as many as the sources hold, or None for the largest at which the weights hold exactly.

        With ``entropy_of_targets`` the weights are the sources' own shares tempered to the targets' entropy instead of the targets.
        """
        cut = lambda bits: F.pmod(F.shiftrightunsigned("h", bits), F.lit(BLOCKS)).cast("int")
        self.texts = written(texts_once(documents, targets, vocabulary).withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("block", cut(20)).withColumn("part", cut(40)), "texts")
        # one row for each source that has a target: a given fixed table
        self.targets = {r["source"]: (r["share"], r["repeats"]) for r in targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("repeats")).collect()}
        self.blocks = self.texts.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"))
        self.tokens = {r["source"]: int(r["n"]) for r in self.blocks.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
        goals, repeats = {s: t for s, (t, _) in self.targets.items()}, {s: r for s, (_, r) in self.targets.items()}
        whole = sum(self.tokens.values())
        wanted = float(whole) if total == "all" else total
        if entropy_of_targets and whole:
            shares = {s: n / whole for s, n in self.tokens.items()}
            self.exponent = exponent_for_entropy(shares, entropy(_normal({s: goals[s] for s in shares})))
            self.weights = tempered(shares, self.exponent)
            self.total = wanted if wanted is not None else largest_total(self.tokens, self.weights, repeats)
        else:
            self.weights, self.exponent, self.total = weights_for(self.tokens, goals, repeats, wanted)

    def budgets(self) -> DataFrame:
        """``(source, passes, budget)``: whole passes over a source's texts and the tokens of the last pass."""
        rows = []
        for s, n in sorted(self.tokens.items()):
            wanted = min(self.weights.get(s, 0.0) * self.total, n * self.targets[s][1])
            passes = int(wanted // n) if n else 0
            rows.append((s, passes, int(round(wanted - passes * n)) if passes < self.targets[s][1] else 0))
        return self.texts.sparkSession.createDataFrame(rows, "source string, passes int, budget bigint")

    def plan(self) -> DataFrame:
        """``(doc_id, source, tokens, uses)`` of every text used at least once, ``uses`` being at most its source's limit."""
        budgets = F.broadcast(self.budgets())  # one row for each source

        def placed(sums: DataFrame, by: str) -> DataFrame:
            """Sums in the order of ``by`` within a source: each one's begin, and whether it lies before the budget or after it."""
            w = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
            at = sums.withColumn("begin", F.col("offset") + F.coalesce(F.sum("tokens").over(w), F.lit(0)))
            return at.select("source", by, "passes", "budget", "begin", (F.col("begin") + F.col("tokens") <= F.col("budget")).alias("whole"), (F.col("begin") >= F.col("budget")).alias("none"))

        def settled(rows: DataFrame) -> DataFrame:
            return rows.where("whole OR none").select("doc_id", "source", "tokens", "passes", "budget", "h", "whole")

        # at most BLOCKS rows for each source, twice
        first = self.texts.join(F.broadcast(placed(self.blocks.withColumn("offset", F.lit(0)).join(budgets, "source"), "block")), ["source", "block"])
        edge = first.where("NOT whole AND NOT none").drop("whole", "none")
        parts = edge.groupBy("source", "part").agg(F.sum("tokens").alias("tokens"), F.max("begin").alias("offset"), F.max("passes").alias("passes"), F.max("budget").alias("budget"))
        second = edge.drop("begin", "passes", "budget").join(F.broadcast(placed(parts, "part")), ["source", "part"])
        within = Window.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        last_part = second.where("NOT whole AND NOT none").withColumn("start", F.col("begin") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        # the text at the budget is taken if more than half of it lies before it
        hard = last_part.select("doc_id", "source", "tokens", "passes", "budget", "h", (F.col("start") + F.col("tokens") / 2 < F.col("budget")).alias("whole"))
        last = settled(first).union(settled(second)).union(hard)
        # one more text, or none, for what a source still lacks: the one nearest to it in size
        lack = last.groupBy("source").agg((F.max("budget") - F.sum(F.col("tokens") * F.col("whole").cast("int"))).alias("lack"))
        left = last.where("NOT whole").join(F.broadcast(lack), "source").where("lack > 0 AND abs(lack - tokens) < lack")  # one row for each source
        fill = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("lack") - F.col("tokens")).alias("off"), "h", "doc_id")).alias("m")).select(F.col("m.doc_id").alias("extra"))
        plan = last.join(F.broadcast(fill), F.col("doc_id") == F.col("extra"), "left")
        uses = F.col("passes") + (F.col("whole") | F.col("extra").isNotNull()).cast("int")
        return plan.select("doc_id", "source", "tokens", uses.alias("uses")).where("uses > 0")

    def report(self) -> DataFrame:
        """``(source, target_share, weight, actual_share, tokens, texts, uses, most_uses)`` of each source with a target."""
        rows = [(s, float(t), float(self.weights.get(s, 0.0)), int(r)) for s, (t, r) in sorted(self.targets.items())]
        goal = self.texts.sparkSession.createDataFrame(rows, "source string, target_share double, weight double, max_repeats int")
        used = self.plan().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("texts"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
        j = goal.join(used, "source", "left").na.fill(0, ["tokens", "texts", "uses", "most_uses"])
        total = j.agg(F.sum("tokens").alias("all"))
        return j.join(F.broadcast(total)).select("source", "target_share", "weight", F.round(F.coalesce(F.try_divide("tokens", "all"), F.lit(0.0)), 6).alias("actual_share"), "tokens", "texts", "uses", "most_uses")


def temperature_weights(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(source, tokens, share, weight, exponent)``: the sources' own shares tempered to the targets' entropy."""
    texts = texts_once(documents, targets, vocabulary)
    tokens = {r["source"]: int(r["n"]) for r in texts.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    goal = _normal({r["source"]: r["t"] for r in targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("t")).collect()})
    whole = sum(tokens.values())
    shares = {s: n / whole for s, n in tokens.items()}
    x = exponent_for_entropy(shares, entropy(goal)) if shares else 1.0
    w = tempered(shares, x)
    rows = [(s, tokens[s], shares[s], w[s], x) for s in sorted(shares)]
    return documents.sparkSession.createDataFrame(rows, "source string, tokens bigint, share double, weight double, exponent double")
