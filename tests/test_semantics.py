"""One case per rule that decides whether numbers match."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from carryover.functions import blank, normalise, share, signed_share
from carryover.operators import checks, codes, coverage, measure, profile
from tests.small import claims, code_map, dx, full_coverage, line, months, params, position


def test_status_of_codes_on_a_day(spark):
    """As-of: the latest entry valid that day, both ends included; dots and case do not matter."""
    entries = [
        ("E119", "19", date(2020, 10, 1), None), ("e11.9", "18", date(2023, 10, 1), date(2024, 9, 30)), ("E100", None, date(2020, 1, 1), date(2023, 1, 1)),
        ("E101", "17", date(2023, 1, 1), date(2023, 1, 1)), ("E102", "0", date(2024, 12, 31), None),
    ]
    versions = spark.createDataFrame(entries, "diagnosis_code string, hcc_v24 string, valid_from date, valid_to date")
    used = spark.createDataFrame([(c,) for c in ("E119", "E100", "E101", "E102", "E999", None)], "code string")

    def on(day, table=versions):
        return {r.code: r.s for r in codes.status_on(used, table, day, "s").collect()}

    none = "not listed"
    assert on("2023-01-01") == {"E119": "19", "E100": "no category", "E101": "17", "E102": none, "E999": none, None: none}
    assert on("2024-09-30") == {"E119": "18", "E100": none, "E101": none, "E102": none, "E999": none, None: none}
    assert on("2024-12-31")["E119"] == "19" and on("2024-12-31")["E102"] == "no category"
    assert on("2024-01-01", versions.drop("valid_to"))["E101"] == "17"
    assert on("2024-01-01", versions.limit(0))["E119"] == none


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_positions_merge_by_number_and_bad_text_is_one_null_row(spark):
    d = dx(spark, [position(1, "1", "A"), position(1, "01", "B"), position(2, "x", "C"), position(3, None, "D")])
    assert rows(checks.sequence_values(d)) == [(None, 2, 2, 0.5), (1, 2, 1, 0.5)]


def test_null_line_is_one_line(spark):
    d = dx(spark, [position(None, "01", "A"), position(None, "02", "A"), position(1, "01", "A")])
    assert rows(checks.dx_per_line_distribution(d)) == [(1, 1, 0.5), (2, 1, 0.5)]
    assert rows(checks.sequence_values(d)) == [(1, 2, 1, 0.6667), (2, 1, 0, 0.3333)]


def test_agreement_counts_pairs_and_keeps_nulls_in_the_denominator(spark):
    c = claims(spark, [line(1, 1, "2023-01-01", top="E11.9"), line(2, 1, "2023-01-01", top=None), line(None, 1, "2023-01-01")])
    d = dx(
        spark,
        [position(1, "01", "e119 "), position(1, "1", "I10"), position(2, "01", "I10"), position(None, "01", "I10"), position(1, "02", "X")],
    )
    assert rows(checks.first_position_agreement(c, d)) == [(3, 2, 1, 1, 1, 0.3333)]
    assert rows(checks.disagreeing_pairs(c, d)) == [("I10", "E119", 1)]


def test_nothing_to_compare_gives_null_share(spark):
    c, d = claims(spark, []), dx(spark, [])
    assert rows(checks.first_position_agreement(c, d)) == [(0, 0, 0, 0, 0, None)]


def test_pairs_of_a_wide_line(spark):
    n = 30
    c = claims(spark, [line(7, 1, "2023-01-01", top=f"T{i}") for i in range(n)] * 2)
    d = dx(spark, [position(7, "01", f"D{i}") for i in range(n)] * 3)
    got = rows(checks.disagreeing_pairs(c, d, top=10_000))
    assert len(got) == n * n and {r[2] for r in got} == {6}


def test_year_without_q4_is_absent_and_a_gap_pairs_its_neighbours(spark):
    days = ["2020-10-01"] * 10 + ["2021-05-01"] * 5 + ["2022-12-31"] * 9
    c = claims(spark, [line(i, 1, d) for i, d in enumerate(days)])
    assert rows(checks.q4_ratio(c, params())) == [(2020, 2022, 10, 9, 0.9, True)]


def test_ten_percent_bound(spark):
    days = ["2022-10-01"] * 20 + ["2023-10-01"] * 18 + ["2024-10-01"] * 21
    c = claims(spark, [line(i, 1, d) for i, d in enumerate(days)])
    assert [r[5] for r in rows(checks.q4_ratio(c, params()))] == [True, False]


def test_months_are_distinct_and_missing_months_are_absence(spark):
    m = months(spark, full_coverage(1) + full_coverage(1) + [(2, "2023", None, "FL", 60)] + [(3, "2024", "5", "FL", 60)])
    assert rows(checks.presence_pivot(m, params())) == [(1, 1, 0, 1, 1, 1, 1, 1.0, 1.0)]
    assert rows(checks.membership_grain(m, params())) == [(24, 12, 2), (1, 0, 1), (1, 1, 1)]


def test_bad_month_or_year_fails(spark):
    for bad in ((1, "2023", "May", "FL", 60), (1, "2023", "99", "FL", 60)):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|not a month"):
            checks.presence_pivot(months(spark, [bad]), params()).collect()


def test_null_member_has_no_coverage_row(spark):
    c = claims(spark, [line(1, None, "2023-03-01"), line(2, 5, "2023-03-01"), line(3, 5, "2023-04-01")])
    m = months(spark, full_coverage(5) + [(None, "2023", "01", "FL", 60)])
    assert rows(checks.claims_vs_coverage(c, m, params())) == [(2023, 2, 1, 1, 0.5)]


def test_member_mismatch_uses_the_smallest_member(spark):
    c = claims(spark, [line(i, 10, "2023-01-01") for i in range(1, 6)] + [line(None, 10, "2023-01-01")])
    d = dx(
        spark,
        [
            position(1, "01", "A", 10), position(2, "01", "A", 11), position(3, "01", "A", 9), position(3, "02", "A", 10),
            position(4, "01", "A", None), position(None, "01", "A", 3), position(99, "01", "A", 1),
        ],
    )
    assert rows(checks.join_integrity(c, d, params())) == [(6, 4, 2, 0.6667, 2, 1)]
    assert rows(checks.mismatch_sample(c, d, params())) == [(2, 10, 11, 1, 1), (3, 10, 9, 2, 2)]
    assert len(rows(checks.mismatch_sample(c, d, params(), top=1))) == 1


def test_share_can_be_negative(spark):
    """A line without diagnosis rows counts in the top-line arm only."""
    c = claims(spark, [line(1, 1, "2023-01-01", top="E11.9"), line(2, 2, "2022-12-31", top="E11.9")])
    d = dx(spark, [position(2, "01", "E11.9")])
    m = months(spark, [(1, "2023", "01", " fl ", 60), (2, "2023", "01", "FL", 60), (3, "2023", "01", "GA", 60)])
    got = rows(checks.recorded_share(c, d, m, codes.code_set(code_map(spark), "^E11"), params()))
    assert got == [(2, 1, 0, 0.5, 0.0, -50.0, -1.0)]


def test_family_holds_codes_outside_its_pattern(spark):
    got = {r[0] for r in rows(codes.code_set(code_map(spark), "^E(08|09|10|11|12|13)"))}
    assert got == {"E119", "E1165", "Z794"}


def test_raw_and_normalised_code_counts_differ(spark):
    m = code_map(spark, [("E11.9", "19"), ("e119", "19"), ("E11.8", "19"), ("E118", "0"), ("E117", "")])
    assert rows(codes.category_examples(m, "^E11", raw=True)) == [("19", 3, "E118, E119")]
    assert rows(codes.category_examples(m, "^E11", raw=False)) == [("19", 2, "E118, E119")]


def test_match_rate_ignores_blanks_and_counts_unmapped_as_without_category(spark):
    d = dx(spark, [position(1, "01", c) for c in ("E11.9", "E11.9", "I10", "X99", " ", None)])
    assert rows(checks.match_rate(d, code_map(spark))) == [(3, 2, 1, 0.6667, 4, 0.75, 1, 0.5)]
    assert rows(checks.unmatched_codes(d, code_map(spark))) == [("X99", 1)]


def test_value_profile_keeps_blank_and_names_null(spark):
    c = claims(spark, [line(1, 1, "2023-01-01", place=None), line(2, 1, "2023-01-01", place=" "), line(3, 1, "2023-01-01", place=" ")])
    assert rows(profile.value_profile(c, "claim_line", ["plc_srv_cd"])) == [
        ("claim_line.plc_srv_cd", " ", 2, 0.6667),
        ("claim_line.plc_srv_cd", "(null)", 1, 0.3333),
    ]


def test_probe_flags_lines_not_rows(spark):
    curated = claims(spark, [line(1, 10, "2023-01-01"), line(2, 20, "2023-01-01"), line(3, 30, "2023-01-01"), line(None, 1, "2023-01-01")])
    d = dx(spark, [position(1, "01", "A", 11), position(1, "02", "A", 12), position(2, "01", "A", None), position(2, "02", "A", 20)])
    assert rows(profile.dx_probe(curated, d, params())) == [(3, 2, 0.6667, 1, 1)]


def test_probe_joins_ids_of_different_types(spark):
    curated = claims(spark, [line(1, 10, "2023-01-01")]).withColumn("claim_line_id", F.lit("1"))
    d = dx(spark, [position(1, "01", "A", 10)])
    assert rows(profile.dx_probe(curated, d, params())) == [(1, 1, 1.0, 0, 0)]


def test_unassigned_and_excluded_lines_are_not_measured(spark):
    c = claims(
        spark,
        [
            line(1, 1, "2023-01-01"), line(2, 1, "2023-01-02", place="XX"), line(3, 1, "2023-01-03", source="LAB"),
            line(4, 1, "2023-01-04", book="CP"), line(5, 1, "2022-12-31"), line(6, 1, "2024-12-31", source=None, place="IP"),
        ],
    )
    got = measure.measured_claims(c, params())
    assert sorted((r.claim_line_id, r.setting) for r in got.collect()) == [(1, "office"), (6, "inpatient")]


def test_death_on_the_last_day_is_a_death(spark):
    unit = spark.createDataFrame([("b", "c", m) for m in (1, 2, 3)], "book string, condition string, member_id bigint")
    dead = spark.createDataFrame([(1, date(2024, 12, 31)), (2, date(2025, 1, 1))], "member_id bigint, death_dt date")
    got = {r.member_id: r.alive for r in measure.gate_death(unit, dead, params()).collect()}
    assert got == {1: False, 2: True, 3: True}
    assert {r.alive for r in measure.gate_death(unit, None, params()).collect()} == {None}


def test_membership_build_keeps_medical_rows_of_both_books(spark):
    raw = spark.createDataFrame(
        [
            (1, date(2023, 3, 1), "Y", "ME"), (2, date(2023, 3, 1), "N", "ME"),
            (3, date(2023, 11, 1), "Y", "CP"), (4, date(2023, 3, 1), "Y", "XX"),
        ],
        "member_id bigint, eff_dt date, medical_ind string, business_ln_cd string",
    )
    for c in ("gender_cd", "mbr_county_cd", "mbr_state", "mbr_submarket"):
        raw = raw.withColumn(c, F.lit("x"))
    got = coverage.build_member_month(raw.withColumn("age_nbr", F.lit(60).cast("long")), params().with_(books={"ME": "medicare", "CP": "commercial"}))
    assert sorted((r.member_id, r.eff_yr, r.eff_mo, r.business_ln_cd) for r in got.collect()) == [
        (1, "2023", "03", "ME"), (3, "2023", "11", "CP"),
    ]


def test_rounding_is_half_up_on_integers(spark):
    df = spark.createDataFrame([(8565, 60000), (1, 3), (0, 0), (-1, 8)], "n bigint, d bigint")
    assert [r[0] for r in df.select(share(F.abs("n"), F.col("d"))).collect()] == [0.1428, 0.3333, None, 0.125]
    assert df.select(signed_share(F.col("n"), F.col("d"), 2)).collect()[3][0] == -0.13


def test_normalise(spark):
    df = spark.createDataFrame([(" e11.9 ",), ("E119",), (None,)], "c string")
    assert [r[0] for r in df.select(normalise(F.col("c"))).collect()] == ["E119", "E119", None]


def test_tabs_and_line_ends_are_blanks(spark):
    df = spark.createDataFrame([("\te11.9\r\n",), ("E119\t",), (" \t\r\n",)], "c string")
    assert [r[0] for r in df.select(normalise(F.col("c"))).collect()] == ["E119", "E119", ""]
    assert [r[0] for r in df.select(blank(F.col("c"))).collect()] == [False, False, True]
