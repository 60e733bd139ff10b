"""Coverage months per member, kept as bit sets.

A month is one bit of a long.  Distinct months then merge with ``bit_or`` in
one partial and one final hash aggregate: no distinct, no second shuffle, and a
member with any number of rows arrives as one number per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.params import Params


def _month_bit() -> Column:
    """Text that is no number fails the query, like a number that has no bit; a
    missing month sets none."""
    return F.expr(
        "CASE WHEN eff_mo IS NULL THEN 0L"
        " WHEN CAST(eff_mo AS INT) BETWEEN 0 AND 62 THEN shiftleft(1L, CAST(eff_mo AS INT))"
        " ELSE raise_error('eff_mo is not a month') END"
    )


def coverage_rows(member_month: DataFrame, p: Params) -> DataFrame:
    """(member_id, yr, month bit) of both years."""
    year = F.col("eff_yr").cast("int")
    return member_month.where(year.isin(*p.years)).select(
        "member_id", year.alias("yr"), _month_bit().alias("month")
    )


def months_held(year: int | None = None) -> Column:
    """Aggregate: distinct months, of one year or over all rows of the group."""
    bits = F.col("month") if year is None else F.when(F.col("yr") == year, F.col("month"))
    return F.coalesce(F.bit_count(F.bit_or(bits)), F.lit(0))


def coverage_months(member_month: DataFrame, p: Params) -> DataFrame:
    """Distinct covered months per member over both years (24 is unbroken)."""
    return (
        coverage_rows(member_month, p)
        .groupBy("member_id")
        .agg((months_held(p.y1) + months_held(p.y2)).cast("long").alias("months"))
    )


def build_member_month(member_raw: DataFrame, p: Params) -> DataFrame:
    """Member-months from raw membership: medical coverage under one of the books.

    The month is taken apart into text, and the book is kept so that later
    figures can tell the books apart.
    """
    day = F.col("eff_dt")
    return member_raw.where(
        (F.col("medical_ind") == "Y") & F.col("business_ln_cd").isin(*p.books)
    ).select(
        "member_id",
        F.year(day).cast("string").alias("eff_yr"),
        F.lpad(F.month(day).cast("string"), 2, "0").alias("eff_mo"),
        "age_nbr",
        "gender_cd",
        "mbr_county_cd",
        "mbr_state",
        "mbr_submarket",
        "business_ln_cd",
    )
