"""One row per key where few keys repeat, and joins on keys of which a few are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.storage import small_enough, written


def balanced(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the cluster has cores, where it is a plain scan that has fewer.

    Work on whole texts takes far longer than reading them, and a small table in one file is one task. An input of at least as
    many splits as cores, as any large one is, isn't moved, nor is anything that has gone through an exchange.
    """
    plan = df._jdf.queryExecution().executedPlan()  # type: ignore[operator]
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()  # type: ignore[operator]
    return df.repartition(cores) if 0 < parts < cores else df


def one_per_key(df: DataFrame, key: str, newest: str, max_broadcast_rows: int = 200_000) -> DataFrame:
    """One row for each value of ``key``: that with the greatest ``newest`` (ties: any, the rows being copies).

    Wide rows aren't shuffled as long as few keys repeat: a narrow count finds the repeated keys,
    rows of all other keys pass by unmoved, and only the repeated ones are reduced. Where more than
    ``max_broadcast_rows`` keys repeat, the list isn't broadcast but joined by exchange. Rows with a NULL key are left out.
    """
    df = balanced(df.where(F.col(key).isNotNull()))
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_k"))
    repeated = written(counts, "repeated")
    if small_enough(repeated, 0):
        return df
    if small_enough(repeated, max_broadcast_rows):
        repeated = F.broadcast(repeated)
    once = df.join(repeated, F.col(key) == F.col("_k"), "left_anti")
    rest = df.join(repeated, F.col(key) == F.col("_k"), "left_semi")
    whole = F.struct(*[F.col(c) for c in df.columns])
    best = rest.groupBy(key).agg(F.max_by(whole, F.struct(newest)).alias("_r")).select("_r.*")
    return once.unionByName(best)


def join_counted(big: DataFrame, small: DataFrame, key: str | list[str], count: str, how: str = "inner", max_broadcast_rows: int = 200_000, hot: int = 20_000) -> DataFrame:
    """``big`` joined (``inner`` or ``left``) to ``small``, a written table with one row for each ``key`` and the number of rows of ``big``
    that have it in ``count``.

    A small table is broadcast. Beyond ``max_broadcast_rows`` its keys of more than ``hot`` rows are, of which there
    are no more than rows of ``big`` / ``hot``, and the others, none of them hot, join by exchange. Where even the
    hot keys are too many to broadcast ``hot`` is raised by tens until they are few.
    """
    keys = [key] if isinstance(key, str) else key
    if small_enough(small, max_broadcast_rows):
        return big.join(F.broadcast(small), keys, how)
    crowded = small.where(F.col(count) > hot)
    while not small_enough(crowded, max_broadcast_rows):
        hot *= 10
        crowded = small.where(F.col(count) > hot)
    return big.join(F.broadcast(crowded), keys).unionByName(
        big.join(F.broadcast(crowded.select(*keys)), keys, "left_anti").join(small.where(F.col(count) <= hot), keys, how)
    )
