"""Two tables laid out once for every join on their shared key.

Rows of hot keys - keys with more rows than a task should hold, in either table -
are kept apart in plain tables; the rest is bucketed and sorted on the key in as many
buckets for one table as for the other.  What joins or counts by the key then runs on
each part by itself and is put together: the rest needs no exchange of either table,
and the hot rows are an ordinary join or aggregate, which partial aggregation and the
adaptive skew join split as they could not split a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

#: Rows of one key, in either table, above which it is kept apart.
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Prepared:
    """The (left, right) tables in parts with disjoint keys."""

    rest: tuple[DataFrame, DataFrame]
    hot: tuple[DataFrame, DataFrame]

    def __iter__(self) -> Iterator[tuple[DataFrame, DataFrame]]:
        return iter((self.rest, self.hot))

    def left(self) -> DataFrame:
        """The left table as one relation."""
        return self.rest[0].unionByName(self.hot[0])

    def right(self) -> DataFrame:
        """The right table as one relation."""
        return self.rest[1].unionByName(self.hot[1])


def hot_keys(left: DataFrame, right: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows in either table: at most one in so many rows."""
    def often(df: DataFrame) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)

    return often(left).select(key).union(often(right).select(key)).distinct()


def write_prepared(
    left: DataFrame, right: DataFrame, key: str, name: str, *, buckets: int, hot_rows: int = HOT_ROWS, folder: str | None = None
) -> Prepared:
    """Save both tables under ``name`` and read them back; the files lie in ``folder``, or in
    the session's warehouse where it is None.

    Rows without a key stay with the hot ones: they meet nothing, and in a bucket
    they would all be one task's.  The hot keys are written first, so that their size
    is known to the planner when the tables are split.
    """
    spark = left.sparkSession

    def save(writer: DataFrameWriter, table: str) -> None:
        if folder is not None:
            writer = writer.option("path", f"{folder}/{table}")
        writer.mode("overwrite").saveAsTable(table)

    save(hot_keys(left, right, key, hot_rows).write, f"{name}_hot_keys")
    hot = spark.table(f"{name}_hot_keys")
    for side, df in (("left", left), ("right", right)):
        apart = df.join(hot.withColumn("_hot", F.lit(True)), key, "left").select(*df.columns, "_hot")
        plain = F.col("_hot").isNull() & F.col(key).isNotNull()
        rest = apart.where(plain).drop("_hot").repartition(buckets, key)
        save(rest.write.bucketBy(buckets, key).sortBy(key), f"{name}_{side}")
        save(apart.where(~plain).drop("_hot").write, f"{name}_{side}_hot")
    return read_prepared(spark, name)


def read_prepared(spark: SparkSession, name: str) -> Prepared:
    """The tables :func:`write_prepared` saved under ``name``."""
    rest, hot = (tuple(spark.table(f"{name}_{side}{tag}") for side in ("left", "right")) for tag in ("", "_hot"))
    return Prepared(rest, hot)


def by_part(tables: Prepared, make: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``make(left, right)`` of every part, put under each other.

    Right wherever no row of ``make`` depends on rows of two keys: joins on the key
    and aggregates by it.  What sums up over keys comes after.
    """
    parts = [make(left, right) for left, right in tables]
    return parts[0].unionByName(parts[1])
