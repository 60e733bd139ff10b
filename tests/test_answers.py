"""Answers worked out once by hand at scale 0.01, as written in FIXTURES.md."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from carryover.operators import measure
from carryover.plans.registry import QUERIES
from carryover.plans.study import Study
from carryover.sources import fixture_params, fixture_tables
from tests.conftest import SF_DIR

VIEW_ROWS = {
    "code_map": 1867,
    "dx_line": 60000,
    "claim_line": 15000,
    "member_month": 31680,
    "provider": 100,
    "curated_claims": 14505,
    "chronic_ref": 1309,
    "member_death": 41,
}


@pytest.fixture(scope="module")
def tables(spark):
    return fixture_tables(spark, SF_DIR)


def one(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert len(rows) == 1
    return tuple(rows[0])


def test_view_rows(tables):
    assert {n: tables[n].count() for n in VIEW_ROWS} == VIEW_ROWS


def test_v1(spark):
    rows = {r.sequence_id: (r.dx_rows, r.claim_lines, r.share_of_rows) for r in QUERIES["v1_sequence_values"](spark, SF_DIR).collect()}
    assert rows[None][0] == 85 and rows[None][2] == 0.0014
    assert rows[1] == (8576, 6556, 0.1429)
    assert rows[2] == (8565, 6543, 0.1428)  # the rounding tie
    assert [rows[i][2] for i in range(3, 8)] == [0.1413, 0.1408, 0.1435, 0.1441, 0.1432]


@pytest.mark.parametrize(
    "name, answer",
    [
        ("v2_dx_per_line_summary", (14743, 60000, 4.07, 0.0760, 0.0028, 13)),
        ("v3_seq1_agreement", (8576, 6556, 6398, 2178, 0, 0.7460)),
        ("v5_presence_pivot", (1470, 1320, 150, 0, 1320, 1170, 1170, 0.8980, 0.8864)),
        ("v6_join_integrity", (4672, 4586, 86, 0.9816, 5, 18)),
        ("v7_diabetes_share", (518, 182, 332, 0.3514, 0.6409, 29.0, 0.8242)),
        ("v8_match_rate", (1437, 1306, 131, 0.9088, 59793, 0.9340, 209, 0.3856)),
        ("eda_dx_probe", (10000, 9827, 0.9827, 38, 69)),
    ],
)
def test_one_row(spark, name, answer):
    assert one(spark, name) == answer


def test_v4(spark):
    rows = QUERIES["v4_q4_ratio"](spark, SF_DIR).collect()
    assert [(r.year_1, r.q4_ratio, r.within_10pct) for r in rows] == [
        (1995, 0.9823, True),
        (1996, 0.9838, True),
        (1997, 1.0604, True),
        (1998, 1.0415, True),
        (1999, 1.0299, True),
    ]


def test_v5_claims(spark):
    rows = [tuple(r) for r in QUERIES["v5_claims_vs_coverage"](spark, SF_DIR).collect()]
    assert rows == [(1999, 1180, 1152, 28, 0.0237), (2000, 1165, 1020, 145, 0.1245)]


def test_v7_codes(spark):
    rows = [tuple(r) for r in QUERIES["v7_diabetes_codes"](spark, SF_DIR).collect()]
    assert [(r[0], r[1]) for r in rows] == [("17", 6), ("18", 6), ("19", 30)]
    assert rows[2][2] == "E082, E083, E084, E085, E086"


def test_submarkets(spark):
    rows = [tuple(r) for r in QUERIES["eda_submarket_cardinality"](spark, SF_DIR).collect()]
    assert rows == [("mbr_submarket", 15, 0, 14505), ("prvdr_submarket", 6, 3663, 14505)]


def test_two_mentions(tables):
    p = fixture_params().with_(families={"diabetes": "^E(08|09|10|11|12|13)"}, books={"ME": "medicare"})
    summary = Study(tables, p).summary
    groups = {
        r.k: (r.n, r.a, r.o)
        for r in summary.where("mentions > 0")
        .groupBy((F.col("mentions") >= 2).alias("k"))
        .agg(F.count("*").alias("n"), F.count_if("carried_any").alias("a"), F.count_if("carried_office").alias("o"))
        .collect()
    }
    assert groups == {True: (202, 88, 65), False: (471, 215, 164)}


def test_attrition_over_both_books(tables):
    p = fixture_params().with_(
        families={"diabetes": "^E(08|09|10|11|12|13)"}, books={"ME": "all", "CP": "all"}
    )
    t = {k: v for k, v in tables.items() if k != "member_death"}
    rows = {r.gate: (r.applied, r.removed, r.remaining) for r in Study(t, p).attrition.collect()}
    assert rows == {
        "confirmed": (True, 0, 333),
        "death": (False, 0, 333),
        "coverage": (True, 79, 254),
        "no_visit": (True, 63, 191),
        "changed_doctor": (True, 26, 165),
    }


def test_panels_over_both_books(tables):
    p = fixture_params().with_(
        families={"diabetes": "^E(08|09|10|11|12|13)"}, books={"ME": "all", "CP": "all"}
    )
    sizes = [r.panel_confirmed for r in Study(tables, p).scores.collect()]
    assert len(sizes) == 12 and min(sizes) == 26 and max(sizes) == 40


def test_years_are_date_ranges(tables):
    """No rows of the pair years are lost at their ends."""
    p = fixture_params()
    days = measure.two_years(tables["claim_line"], p).agg(F.min("srv_start_dt"), F.max("srv_start_dt")).first()
    assert str(days[0]) >= "1999-01-01" and str(days[1]) <= "2000-12-31"
