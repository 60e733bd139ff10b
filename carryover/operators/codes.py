"""Condition families, derived from the code map and never written down."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carryover.functions import blank, normalise, trimmed


def has_category(category: Column) -> Column:
    """Fixed values: '' and '0' both mean a code without a category."""
    return F.coalesce(~category.cast("string").isin("", "0"), F.lit(False))


def code_categories(code_map: DataFrame) -> DataFrame:
    """Distinct (code, category) of every code with a category."""
    return _mapped_codes(code_map).distinct()


def _mapped_codes(code_map: DataFrame) -> DataFrame:
    return code_map.where(has_category(F.col("hcc_v24"))).select(
        normalise(F.col("diagnosis_code")).alias("code"),
        F.col("hcc_v24").cast("string").alias("category"),
    )


def category_examples(code_map: DataFrame, pattern: str, *, raw: bool) -> DataFrame:
    """Categories reached by codes matching ``pattern``, with the evidence.

    ``raw`` counts codes as written; otherwise as normalised.  The five examples
    are ranked per task first, so no category is gathered whole.
    """
    written = F.col("diagnosis_code")
    if raw:
        clean = normalise(written)
    else:
        clean = F.upper(F.replace(trimmed(written), F.lit("."), F.lit("")))
    codes = (
        code_map.where(has_category(F.col("hcc_v24")))
        .select(
            F.col("hcc_v24").cast("string").alias("hcc_v24"),
            clean.alias("code"),
            (written if raw else clean).alias("counted"),
        )
        .where(F.col("code").rlike(pattern))
    )
    in_order = Window.partitionBy("hcc_v24").orderBy("code")
    examples = (
        codes.select("hcc_v24", "code")
        .distinct()
        .withColumn("place", F.row_number().over(in_order))
        .where(F.col("place") <= 5)
        .groupBy("hcc_v24")
        .agg(F.array_join(F.array_sort(F.collect_list("code")), ", ").alias("example_codes"))
    )
    return (
        codes.groupBy("hcc_v24")
        .agg(F.countDistinct("counted").alias("icd_codes"))
        .join(examples, "hcc_v24")
        .orderBy("hcc_v24")
    )


def family_codes(code_map: DataFrame, families: Mapping[str, str]) -> DataFrame:
    """(condition, category, code): every code of every category a family reaches.

    A family is a code pattern.  The categories its codes map to define it, and
    the family then holds all codes of those categories, also those outside
    the pattern.
    """
    mapped = _mapped_codes(code_map)
    matched = None
    for name, pattern in families.items():
        condition = F.when(F.col("code").rlike(pattern), F.lit(name))
        matched = condition if matched is None else F.concat_ws("|", matched, condition)
    reached = (
        mapped.select("category", F.explode(F.split(matched, r"\|")).alias("condition"))
        .where(F.col("condition") != "")
        .distinct()
    )
    return mapped.distinct().join(reached, "category").select("condition", "category", "code")


def code_set(code_map: DataFrame, pattern: str) -> DataFrame:
    """Distinct codes of one family."""
    return family_codes(code_map, {"family": pattern}).select("code").distinct()


#: A code outside every list that was valid on a day.
NOT_LISTED = "not listed"


def status_on(codes: DataFrame, versions: DataFrame, day: str, out: str) -> DataFrame:
    """``codes`` (code) with the status each had on ``day``: an as-of join.

    ``versions`` holds (diagnosis_code, hcc_v24, valid_from, valid_to): the list entries
    of every vintage, each valid from one day to another, both included; an open
    end is NULL.  Of several entries valid that day the latest counts.  A status
    is the category, 'no category', or 'not listed'.  Both sides are at most one
    row per code and entry, whatever the claims.
    """
    at = F.lit(day).cast("date")
    until = F.col("valid_to") if "valid_to" in versions.columns else F.lit(None).cast("date")
    valid = versions.where((F.col("valid_from") <= at) & (until.isNull() | (until >= at)))
    category = F.when(has_category(F.col("hcc_v24")), F.col("hcc_v24").cast("string")).otherwise("no category")
    then = valid.groupBy(normalise(F.col("diagnosis_code")).alias("code")).agg(
        F.max(F.struct("valid_from", category.alias("status")))["status"].alias(out)
    )
    return codes.join(then, "code", "left").withColumn(out, F.coalesce(out, F.lit(NOT_LISTED)))


def chronic_codes(chronic_ref: DataFrame) -> DataFrame:
    """Codes the long-term condition reference marks as chronic."""
    return (
        chronic_ref.where(F.col("chronic_indicator").cast("string") == "1")
        .select(normalise(F.col("icd_code")).alias("code"))
        .distinct()
    )


def code_volume(dx_line: DataFrame) -> DataFrame:
    """Rows per normalised code.  Partial aggregation leaves one row per code
    and task, so a code that holds a third of all rows costs nothing extra."""
    return (
        dx_line.where(~blank(F.col("icd9_dx_cd")))
        .groupBy(normalise(F.col("icd9_dx_cd")).alias("icd9_dx_cd"))
        .agg(F.count(F.lit(1)).alias("dx_rows"))
    )
