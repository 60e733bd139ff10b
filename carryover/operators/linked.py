"""The checks and joins on the claim line id over prepared tables.

``tables`` hold claim lines (left) and diagnosis rows (right) in two parts with
disjoint ids (:mod:`carryover.sources.prepared`).  The rest is bucketed and sorted on
the id: it is counted and joined where it lies, so neither table is exchanged.  The
hot part takes the plain way, whose partial aggregates and skew joins split an id.
Each part gives counts, which are added.  Joins on (id, code) stay within buckets of
the id under ``spark.sql.requireAllClusterKeysForCoPartition = false``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.operators import checks, measure
from carryover.params import Params
from carryover.sources.prepared import Prepared, by_part


def _added(parts: list[DataFrame]) -> DataFrame:
    """One-row counts of several parts as one row."""
    every = parts[0].unionByName(parts[1])
    return every.agg(*[F.sum(c).alias(c) for c in every.columns])


def _line_members_in_place(claim_line: DataFrame, dx_line: DataFrame, p: Params) -> DataFrame:
    """Per (line, member) of the claims, how the members of the line compare; by a join,
    since both sides are already together."""
    lines = checks.two_years(claim_line, p).groupBy("claim_line_id", "member_id").agg(F.count(F.lit(1)).alias("claims"))
    members = dx_line.groupBy("claim_line_id", F.col("member_id").alias("dx_member_id")).agg(F.count(F.lit(1)).alias("n"))
    per_line = members.groupBy("claim_line_id").agg(
        F.sum("n").alias("dx_rows"),
        F.count("dx_member_id").alias("distinct_members"),
        F.min("dx_member_id").alias("dx_member_id"),
    )
    other = F.coalesce(F.col("member_id") != F.col("dx_member_id"), F.lit(False))
    return lines.join(per_line, "claim_line_id", "left").select(
        "claims",
        F.coalesce("dx_rows", F.lit(0)).alias("dx_rows"),
        F.coalesce("distinct_members", F.lit(0)).alias("distinct_members"),
        F.when(other, F.col("claims")).otherwise(0).alias("claims_other"),
    )


def join_integrity(tables: Prepared, p: Params) -> DataFrame:
    """V6 over prepared tables."""
    rest = checks.link_counts(_line_members_in_place(*tables.rest, p))
    hot = checks.link_counts(checks._line_members(*tables.hot, p))
    return checks.with_match_rate(_added([rest, hot]))


def _agreement_in_place(claim_line: DataFrame, dx_line: DataFrame) -> DataFrame:
    """Counts of V3: totals of a line meet by its id, equal codes by id and code."""
    dx = checks._position_one_counts(dx_line).withColumnRenamed("icd9_dx_cd_seq1", "code")
    top = checks._top_line_counts(claim_line).withColumnRenamed("pri_icd9_dx_cd", "code")

    def totals(df: DataFrame, n: str, out: str) -> DataFrame:
        known = F.coalesce(F.sum(F.when(F.col("code").isNotNull(), F.col(n))), F.lit(0))
        return df.groupBy("claim_line_id").agg(F.sum(n).alias(out), known.alias(f"{out}_known"))

    pairs, known = F.col("d") * F.col("t"), F.col("d_known") * F.col("t_known")

    def total(n: Column) -> Column:
        return F.coalesce(F.sum(n), F.lit(0))

    lines = totals(dx, "n_dx", "d").join(totals(top, "n_top", "t"), "claim_line_id")
    sums = lines.agg(
        total(pairs).alias("compared_rows"),
        F.count(F.lit(1)).alias("compared_claim_lines"),
        total(known).alias("known"),
        total(pairs - known).alias("null_either"),
    )
    same = dx.join(top, ["claim_line_id", "code"]).agg(total(F.col("n_dx") * F.col("n_top")).alias("agree"))
    agree = same.scalar()
    return sums.select(
        "compared_rows",
        "compared_claim_lines",
        agree.alias("agree"),
        (F.col("known") - agree).alias("disagree"),
        "null_either",
    )


def first_position_agreement(tables: Prepared) -> DataFrame:
    """V3 over prepared tables."""
    rest = _agreement_in_place(*tables.rest)
    hot = checks.agreement_counts(*tables.hot)
    return checks.with_agreement(_added([rest, hot]))


def disagreeing_pairs(tables: Prepared, top: int = 200) -> DataFrame:
    """The pairs of V3 over prepared tables."""
    return checks.most_frequent_pairs(by_part(tables, checks.line_pairs), top)


def recorded_share(tables: Prepared, member_month: DataFrame, codes: DataFrame, p: Params, name: str = "diabetes") -> DataFrame:
    """V7 over prepared tables."""
    every = by_part(tables, lambda claims, dx: checks.members_by_position(claims, dx, codes, p))
    return checks.share_of_members(every, tables.left(), member_month, codes, p, name)


def expand_positions(tables: Prepared, p: Params) -> DataFrame:
    """Claim line x diagnosis position of both years over prepared tables."""
    return by_part(tables, lambda claims, dx: measure.expand_positions(checks.two_years(claims, p), dx))


def condition_records(tables: Prepared, labels: DataFrame, p: Params) -> DataFrame:
    """Condition records over prepared tables."""
    return by_part(tables, lambda claims, dx: measure.labelled(claims, dx, labels, p))
