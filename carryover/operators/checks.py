"""Gate 1: can the data answer the question at all?  Checks V1 to V8.

Where a check needs only counts over two large tables, both are tagged, put
under each other and aggregated by the shared key.  That takes the place of a
join: partial aggregation shrinks a hot key before it is shuffled, no pair of
rows is ever formed, and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carryover.functions import (
    in_years,
    normalise,
    ratio,
    share,
    share_of_total,
    signed_share,
    trimmed,
)
from carryover.operators.codes import code_volume, has_category
from carryover.operators.coverage import coverage_rows, months_held
from carryover.params import Params


def _rows() -> Column:
    return F.count(F.lit(1))


def _sum_if(condition: Column, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def position(sequence: Column) -> Column:
    """A zero-padded position as a number; NULL when the text is not one."""
    return sequence.try_cast("int")


# --- V1, V2: are there several positions? ----------------------------------


def sequence_values(dx_line: DataFrame) -> DataFrame:
    """Rows and distinct lines per diagnosis position."""
    per_line = dx_line.groupBy(
        "claim_line_id", position(F.col("sequence_id")).alias("sequence_id")
    ).agg(_rows().alias("n"))
    groups = per_line.groupBy("sequence_id").agg(
        F.sum("n").alias("dx_rows"), F.count("claim_line_id").alias("claim_lines")
    )
    return share_of_total(groups, "dx_rows", "share_of_rows").orderBy("sequence_id")


def _dx_per_line(dx_line: DataFrame) -> DataFrame:
    return dx_line.groupBy("claim_line_id").agg(_rows().alias("n"))


def dx_per_line_summary(dx_line: DataFrame) -> DataFrame:
    """Lines, rows, mean and tail of the number of diagnoses per line."""
    n = F.col("n")
    return _dx_per_line(dx_line).agg(
        _rows().alias("claim_lines"),
        F.sum(n).alias("dx_rows"),
        share(F.sum(n), _rows(), 2).alias("avg_dx_per_claim_line"),
        share(F.count_if(n == 1), _rows()).alias("share_exactly_one"),
        share(F.count_if(n > 10), _rows()).alias("share_over_ten"),
        F.max(n).alias("max_dx_per_claim_line"),
    )


def dx_per_line_distribution(dx_line: DataFrame) -> DataFrame:
    """The histogram behind :func:`dx_per_line_summary`."""
    groups = (
        _dx_per_line(dx_line)
        .groupBy(F.col("n").alias("dx_per_claim_line"))
        .agg(_rows().alias("claim_lines"))
    )
    return share_of_total(groups, "claim_lines", "share_of_claim_lines").orderBy(
        "dx_per_claim_line"
    )


# --- V3: is position 1 the top-line code? -----------------------------------


def _first_positions(claim_line: DataFrame, dx_line: DataFrame) -> DataFrame:
    """Rows per (line, code): ``n_dx`` at position 1, ``n_top`` on the claim."""
    line = F.col("claim_line_id")
    first = dx_line.where(line.isNotNull() & (position(F.col("sequence_id")) == 1)).select(
        line, normalise(F.col("icd9_dx_cd")).alias("code"), F.lit(1).alias("dx"), F.lit(0).alias("top")
    )
    top = claim_line.where(line.isNotNull()).select(
        line, normalise(F.col("pri_icd9_dx_cd")).alias("code"), F.lit(0).alias("dx"), F.lit(1).alias("top")
    )
    return (
        first.unionByName(top)
        .groupBy("claim_line_id", "code")
        .agg(F.sum("dx").alias("n_dx"), F.sum("top").alias("n_top"))
    )


def agreement_counts(claim_line: DataFrame, dx_line: DataFrame) -> DataFrame:
    """One row of counts for :func:`first_position_agreement`.

    A line with d position-1 rows and t claim rows stands for d * t compared
    rows; these products are summed instead of being formed.
    """
    known = F.col("code").isNotNull()
    per_line = (
        _first_positions(claim_line, dx_line)
        .groupBy("claim_line_id")
        .agg(
            F.sum("n_dx").alias("d"),
            F.sum("n_top").alias("t"),
            _sum_if(known, "n_dx").alias("d_known"),
            _sum_if(known, "n_top").alias("t_known"),
            _sum_if(known, F.col("n_dx") * F.col("n_top")).alias("same"),
        )
        .where((F.col("d") > 0) & (F.col("t") > 0))
    )
    pairs = F.col("d") * F.col("t")
    pairs_known = F.col("d_known") * F.col("t_known")
    return per_line.agg(
        F.coalesce(F.sum(pairs), F.lit(0)).alias("compared_rows"),
        _rows().alias("compared_claim_lines"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("agree"),
        F.coalesce(F.sum(pairs_known - F.col("same")), F.lit(0)).alias("disagree"),
        F.coalesce(F.sum(pairs - pairs_known), F.lit(0)).alias("null_either"),
    )


def with_agreement(counts: DataFrame) -> DataFrame:
    return counts.withColumn("agreement", share(F.col("agree"), F.col("compared_rows")))


def first_position_agreement(claim_line: DataFrame, dx_line: DataFrame) -> DataFrame:
    """Agreement of position 1 with the top-line code over all row pairs."""
    return with_agreement(agreement_counts(claim_line, dx_line))


def _position_one_counts(dx_line: DataFrame) -> DataFrame:
    code = normalise(F.col("icd9_dx_cd"))
    return (
        dx_line.where(F.col("claim_line_id").isNotNull() & (position(F.col("sequence_id")) == 1))
        .groupBy("claim_line_id", code.alias("icd9_dx_cd_seq1"))
        .agg(_rows().alias("n_dx"))
    )


def _top_line_counts(claim_line: DataFrame) -> DataFrame:
    code = normalise(F.col("pri_icd9_dx_cd"))
    return (
        claim_line.where(F.col("claim_line_id").isNotNull())
        .groupBy("claim_line_id", code.alias("pri_icd9_dx_cd"))
        .agg(_rows().alias("n_top"))
    )


def line_pairs(claim_line: DataFrame, dx_line: DataFrame) -> DataFrame:
    """Disagreeing code pairs of every line with how many row pairs they stand for.

    Both sides meet as counts per (line, code), so repeats of a line are
    multiplied as numbers and not as rows.  A line id with very many codes on
    both sides is an ordinary skewed join key, which adaptive execution splits.
    """
    return (
        _position_one_counts(dx_line)
        .join(_top_line_counts(claim_line), "claim_line_id")
        .where(F.col("icd9_dx_cd_seq1") != F.col("pri_icd9_dx_cd"))
        .select("icd9_dx_cd_seq1", "pri_icd9_dx_cd", (F.col("n_dx") * F.col("n_top")).alias("n"))
    )


def most_frequent_pairs(pairs: DataFrame, top: int = 200) -> DataFrame:
    return (
        pairs.groupBy("icd9_dx_cd_seq1", "pri_icd9_dx_cd")
        .agg(F.sum("n").alias("n_rows"))
        .orderBy(F.desc("n_rows"), "icd9_dx_cd_seq1", "pri_icd9_dx_cd")
        .limit(top)
    )


def disagreeing_pairs(claim_line: DataFrame, dx_line: DataFrame, top: int = 200) -> DataFrame:
    """The code pairs that disagree most often."""
    return most_frequent_pairs(line_pairs(claim_line, dx_line), top)


# --- V4: are both years equally complete? -----------------------------------


def monthly_volume(claim_line: DataFrame, p: Params) -> DataFrame:
    """Lines and members per month, counted per (month, member) first."""
    day = F.col("srv_start_dt")
    return (
        claim_line.where(in_years(day, p.first_year, p.last_year))
        .groupBy(F.year(day).alias("yr"), F.month(day).alias("mo"), "member_id")
        .agg(_rows().alias("n"))
        .groupBy("yr", "mo")
        .agg(F.sum("n").alias("claim_lines"), F.count("member_id").alias("members"))
        .orderBy("yr", "mo")
    )


def q4_ratio(claim_line: DataFrame, p: Params) -> DataFrame:
    """Fourth-quarter volume of each year against the year before it that has one.

    The window has no partition, over one row per year of the range.
    """
    day = F.col("srv_start_dt")
    per_year = (
        claim_line.where(in_years(day, p.first_year, p.last_year) & (F.quarter(day) == 4))
        .groupBy(F.year(day).alias("year_2"))
        .agg(_rows().alias("q4_year_2"))
    )
    by_year = Window.orderBy("year_2")
    change = ratio(F.col("q4_year_2"), F.col("q4_year_1"))
    return (
        per_year.withColumn("year_1", F.lag("year_2").over(by_year))
        .withColumn("q4_year_1", F.lag("q4_year_2").over(by_year))
        .where(F.col("year_1").isNotNull())
        .select(
            "year_1",
            "year_2",
            "q4_year_1",
            "q4_year_2",
            share(F.col("q4_year_2"), F.col("q4_year_1")).alias("q4_ratio"),
            (F.abs(change - 1) <= 0.10).alias("within_10pct"),
        )
        .orderBy("year_2")
    )


# --- V5: do members keep their identifier? ----------------------------------


def membership_grain(member_month: DataFrame, p: Params, top: int = 100) -> DataFrame:
    """How many rows and distinct months a member-year has."""
    return (
        coverage_rows(member_month, p)
        .groupBy("member_id", "yr")
        .agg(
            _rows().alias("rows_in_year"),
            months_held().cast("long").alias("distinct_months"),
        )
        .groupBy("rows_in_year", "distinct_months")
        .agg(_rows().alias("member_years"))
        .orderBy(F.desc("member_years"), "rows_in_year", "distinct_months")
        .limit(top)
    )


def presence_pivot(member_month: DataFrame, p: Params) -> DataFrame:
    """Members present in one or both years, and fully covered ones.

    One aggregate per member over both years; column names carry the years.
    """

    y1, y2 = p.years
    per_member = coverage_rows(member_month, p).groupBy("member_id").agg(
        months_held(y1).alias("m1"), months_held(y2).alias("m2")
    )
    first, second, full = F.col("m1") > 0, F.col("m2") > 0, F.col("m1") == 12
    counts = per_member.agg(
        F.count_if(first).alias(f"members_{y1}"),
        F.count_if(first & second).alias("in_both_years"),
        F.count_if(first & ~second).alias(f"only_{y1}"),
        F.count_if(~first & second).alias(f"new_{y2}"),
        F.count_if(full).alias(f"full_12m_{y1}"),
        F.count_if(full & second).alias(f"full_{y1}_present_{y2}"),
        F.count_if(full & (F.col("m2") == 12)).alias("full_12m_both"),
    )
    return counts.withColumns(
        {
            f"share_present_{y2}": share(F.col("in_both_years"), F.col(f"members_{y1}")),
            f"share_full_{y1}_present_{y2}": share(
                F.col(f"full_{y1}_present_{y2}"), F.col(f"full_12m_{y1}")
            ),
        }
    )


def claims_vs_coverage(claim_line: DataFrame, member_month: DataFrame, p: Params) -> DataFrame:
    """Member-years with claims, with and without a coverage row."""
    day = F.col("srv_start_dt")
    claimed = two_years(claim_line, p).select(
        "member_id", F.year(day).alias("yr"), F.lit(True).alias("claim"), F.lit(False).alias("cover")
    )
    covered = coverage_rows(member_month, p).where(F.col("member_id").isNotNull()).select(
        "member_id", "yr", F.lit(False).alias("claim"), F.lit(True).alias("cover")
    )
    per_year = (
        claimed.unionByName(covered)
        .groupBy("member_id", "yr")
        .agg(F.bool_or("claim").alias("claim"), F.bool_or("cover").alias("cover"))
        .where("claim")
        .groupBy("yr")
        .agg(
            _rows().alias("claim_members"),
            F.count_if("cover").alias("matched_to_coverage"),
            F.count_if(~F.col("cover")).alias("no_coverage_row"),
        )
    )
    return per_year.withColumn(
        "share_no_coverage_row", share(F.col("no_coverage_row"), F.col("claim_members"))
    ).orderBy("yr")


# --- V6: does the visit link hold? ------------------------------------------


def two_years(claim_line: DataFrame, p: Params) -> DataFrame:
    """Claim lines with service in either year of the pair."""
    day = F.col("srv_start_dt")
    if p.y2 == p.y1 + 1:
        return claim_line.where(in_years(day, p.y1, p.y2))
    return claim_line.where(in_years(day, p.y1) | in_years(day, p.y2))


def _line_members(claim_line: DataFrame, dx_line: DataFrame, p: Params) -> DataFrame:
    """Per claim line: rows on each side and how their members compare.

    The member a line has on the diagnosis side is its smallest, so that the
    comparison does not depend on row order.
    """
    lines = two_years(claim_line, p).select(
        "claim_line_id", "member_id", F.lit(1).alias("claim"), F.lit(0).alias("dx")
    )
    positions = dx_line.where(F.col("claim_line_id").isNotNull()).select(
        "claim_line_id", "member_id", F.lit(0).alias("claim"), F.lit(1).alias("dx")
    )
    named = F.col("member_id").isNotNull()
    dx_member = F.when(F.col("n_dx") > 0, F.col("member_id"))
    return (
        lines.unionByName(positions)
        .groupBy("claim_line_id", "member_id")
        .agg(F.sum("claim").alias("n_claim"), F.sum("dx").alias("n_dx"))
        .groupBy("claim_line_id")
        .agg(
            F.sum("n_claim").alias("claims"),
            F.sum("n_dx").alias("dx_rows"),
            F.count(dx_member).alias("distinct_members"),
            F.min(dx_member).alias("dx_member_id"),
            _sum_if(named, "n_claim").alias("claims_named"),
            F.min_by("n_claim", dx_member).alias("claims_same"),
        )
        .where(F.col("claims") > 0)
        .withColumn(
            "claims_other", F.coalesce(F.col("claims_named") - F.col("claims_same"), F.lit(0))
        )
    )


def link_counts(line_members: DataFrame) -> DataFrame:
    """One row of counts for :func:`join_integrity`."""
    found = F.col("dx_rows") > 0
    return line_members.agg(
        F.coalesce(F.sum("claims"), F.lit(0)).alias("claim_lines"),
        _sum_if(found, "claims").alias("matched"),
        _sum_if(~found, "claims").alias("unmatched"),
        F.coalesce(F.sum("claims_other"), F.lit(0)).alias("member_mismatch"),
        _sum_if(F.col("distinct_members") > 1, "claims").alias("multi_member_lines"),
    )


def with_match_rate(counts: DataFrame) -> DataFrame:
    return counts.select(
        "claim_lines",
        "matched",
        "unmatched",
        share(F.col("matched"), F.col("claim_lines")).alias("match_rate"),
        "member_mismatch",
        "multi_member_lines",
    )


def join_integrity(claim_line: DataFrame, dx_line: DataFrame, p: Params) -> DataFrame:
    """Match rate of claim lines into the diagnosis table, and wrong members."""
    return with_match_rate(link_counts(_line_members(claim_line, dx_line, p)))


def mismatch_sample(
    claim_line: DataFrame, dx_line: DataFrame, p: Params, top: int = 500
) -> DataFrame:
    """The first ``top`` claim rows whose member differs or is not unique.

    Every offending line has such a row, so the first rows lie on the first
    ``top`` offending lines; only these go back to the claims.
    """
    several = F.col("distinct_members") > 1
    lines = (
        _line_members(claim_line, dx_line, p)
        .where(F.col("claim_line_id").isNotNull() & (several | (F.col("claims_other") > 0)))
        .select("claim_line_id", "dx_member_id", "dx_rows", "distinct_members")
        .orderBy("claim_line_id")
        .limit(top)
    )
    return (
        two_years(claim_line, p)
        .select("claim_line_id", F.col("member_id").alias("claim_member_id"))
        .join(F.broadcast(lines), "claim_line_id")
        .where(several | (F.col("claim_member_id") != F.col("dx_member_id")))
        .select("claim_line_id", "claim_member_id", "dx_member_id", "dx_rows", "distinct_members")
        .orderBy("claim_line_id", "claim_member_id")
        .limit(top)
    )


# --- V7: what do the extra positions recover? -------------------------------


def recorded_share(
    claim_line: DataFrame,
    dx_line: DataFrame,
    member_month: DataFrame,
    codes: DataFrame,
    p: Params,
    name: str = "diabetes",
) -> DataFrame:
    """Share of the state's members recorded with one of ``codes`` in year one,
    from the top-line code and from every position.

    Diagnosis rows meet the code set before anything is shuffled, so only the
    lines of the condition travel; the claim side is a semi join, which lets
    Spark filter it with a run-time bloom filter.
    """
    every = members_by_position(claim_line, dx_line, codes, p)
    return share_of_members(every, claim_line, member_month, codes, p, name)


def _with_code(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    return df.withColumn("code", normalise(F.col(column))).join(codes, "code", "left_semi")


def _lines_of_year_one(claim_line: DataFrame, p: Params) -> DataFrame:
    return claim_line.where(in_years(F.col("srv_start_dt"), p.y1) & F.col("member_id").isNotNull())


def members_by_position(claim_line: DataFrame, dx_line: DataFrame, codes: DataFrame, p: Params) -> DataFrame:
    """(claim_line_id, member_id) of the lines of year one with one of ``codes`` at any position."""
    rows = dx_line.where(F.col("claim_line_id").isNotNull()).select("claim_line_id", "icd9_dx_cd")
    hit_lines = _with_code(rows, "icd9_dx_cd", codes).select("claim_line_id").distinct()
    lines = _lines_of_year_one(claim_line, p).select("claim_line_id", "member_id")
    return lines.join(hit_lines, "claim_line_id", "left_semi")


def share_of_members(
    every: DataFrame, claim_line: DataFrame, member_month: DataFrame, codes: DataFrame, p: Params, name: str
) -> DataFrame:
    """:func:`recorded_share` from the rows of :func:`members_by_position`."""
    top = _with_code(_lines_of_year_one(claim_line, p).select("member_id", "pri_icd9_dx_cd"), "pri_icd9_dx_cd", codes)
    state = member_month.where(
        (F.col("eff_yr").cast("int") == p.y1) & (F.upper(trimmed(F.col("mbr_state"))) == p.state)
    )

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select("member_id", *[F.lit(t == tag).alias(t) for t in ("here", "top", "every")])

    per_member = (
        tagged(state, "here")
        .unionByName(tagged(top, "top"))
        .unionByName(tagged(every, "every"))
        .groupBy("member_id")
        .agg(*[F.bool_or(t).alias(t) for t in ("here", "top", "every")])
        .where("here")
    )
    a, b, n = F.count_if("every"), F.count_if("top"), _rows()
    return per_member.agg(
        n.alias("members"),
        b.alias(f"{name}_pri_icd9_dx_cd"),
        a.alias(f"{name}_every_position"),
        share(b, n).alias("share_pri_icd9_dx_cd"),
        share(a, n).alias("share_every_position"),
        signed_share(a - b, n, 1, per=100).alias("diff_pct_points"),
        signed_share(a - b, b).alias("relative_difference"),
    )


# --- V8: do the codes map? ---------------------------------------------------


def match_rate(dx_line: DataFrame, code_map: DataFrame) -> DataFrame:
    """Share of claim codes found in the map, by code and by row.

    Both sides are one row per code before they meet.
    """
    known = (
        code_map.where(trimmed(F.col("diagnosis_code")) != "")
        .groupBy(normalise(F.col("diagnosis_code")).alias("icd9_dx_cd"))
        .agg(F.bool_or(has_category(F.col("hcc_v24"))).alias("has_hcc"))
    )
    joined = code_volume(dx_line).join(known, "icd9_dx_cd", "left")
    matched, rows = F.col("has_hcc").isNotNull(), F.sum("dx_rows")
    return joined.agg(
        _rows().alias("distinct_claim_codes"),
        F.count_if(matched).alias("matched_codes"),
        F.count_if(~matched).alias("unmatched_codes"),
        share(F.count_if(matched), _rows()).alias("match_rate_by_code"),
        rows.alias("dx_rows"),
        share(_sum_if(matched, "dx_rows"), rows).alias("match_rate_by_volume"),
        F.count_if("has_hcc").alias("codes_with_hcc_v24"),
        share(_sum_if(F.col("has_hcc"), "dx_rows"), rows).alias("share_of_rows_with_hcc_v24"),
    )


def unmatched_codes(dx_line: DataFrame, code_map: DataFrame, top: int = 500) -> DataFrame:
    """The unmapped codes with the most rows."""
    known = (
        code_map.where(trimmed(F.col("diagnosis_code")) != "")
        .select(normalise(F.col("diagnosis_code")).alias("icd9_dx_cd"))
        .distinct()
    )
    return (
        code_volume(dx_line)
        .join(known, "icd9_dx_cd", "left_anti")
        .orderBy(F.desc("dx_rows"), "icd9_dx_cd")
        .limit(top)
    )
