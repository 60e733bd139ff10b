"""Shares and ranks over aggregated rows, without a one-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carryover.functions.columns import share


def share_of_total(groups: DataFrame, n: str, out: str, *, parts: int = 1) -> DataFrame:
    """Add ``n`` as a share of its column total.

    The total is a scalar subquery over the same aggregate, so its exchange is
    reused and the groups stay distributed whatever their number.  With
    ``parts`` columns profiled in one pass every part has the same total.
    """
    total = groups.agg(F.sum(n).alias("total")).select(
        F.call_function("div", F.col("total"), F.lit(parts)).alias("total")
    )
    return groups.withColumn(out, share(F.col(n), total.scalar()))


def histogram_rank(df: DataFrame, by: list[str], score: str, out: str) -> DataFrame:
    """``rank() over (partition by .. order by score)`` for a bounded integer score.

    Rows are first counted per (group, score); the window runs over those
    counts - at most one row per possible score - and the rank is joined back.
    A group of any size therefore never sits in one task.
    """
    keys = [*by, score]
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranks = (
        df.where(F.col(score).isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, (F.coalesce(F.sum("_n").over(below), F.lit(0)) + 1).alias(out))
    )
    return df.join(ranks, keys, "left")
