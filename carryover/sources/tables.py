"""Reading the logical tables and writing results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from carryover.sources.contract import CONTRACTS, conform


def read_table(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    """A path (anything with a slash) or the name of a catalog table."""
    return spark.read.format(fmt).load(location) if "/" in location else spark.table(location)


def load_tables(
    spark: SparkSession,
    locations: Mapping[str, str],
    renames: Mapping[str, Mapping[str, str]] | None = None,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Logical tables by name, each brought to its contract.

    Fails with the violations of all tables at once, before any row is read.
    """
    out, wrong = {}, []
    for name, location in locations.items():
        if name not in CONTRACTS:
            wrong.append(f"{name}: no such table")
            continue
        try:
            out[name] = conform(read_table(spark, location, fmt), name, (renames or {}).get(name))
        except ValueError as error:
            wrong.append(str(error))
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def write_result(df: DataFrame, folder: str, name: str, csv: bool = True) -> DataFrame:
    """Write one result as parquet, and as CSV for people; returns it read back."""
    path = f"{folder}/{name}"
    df.write.mode("errorifexists").parquet(f"{path}.parquet")
    back = df.sparkSession.read.parquet(f"{path}.parquet")
    if csv:
        back.write.mode("errorifexists").option("header", True).csv(f"{path}.csv")
    return back
