"""Five patients, all recorded diabetic in 2023; only A and B answer the question."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from carryover.plans.study import Study
from tests.small import claims, code_map, dx, full_coverage, line, months, params, position

A, B, C, D, E = range(1, 6)


def build(spark, *, top_line_only=False):
    lines, codes, n = [], [], 0

    def visit(member, day, *, coded, doctor=1, third=False):
        nonlocal n
        n += 1
        lines.append(line(n, member, day, top="E11.9" if coded and not third else "I10", doctor=doctor))
        codes.append(position(n, "01", "E11.9" if coded and not third else "I10", member))
        if third and not top_line_only:
            codes.append(position(n, "02", "M54.5", member))
            codes.append(position(n, "03", "E11.9", member))

    for member in (A, C, D, E):
        visit(member, "2023-02-01", coded=True)
        visit(member, "2023-08-01", coded=True)
    visit(B, "2023-02-01", coded=True, third=True)
    visit(B, "2023-08-01", coded=True, third=True)
    visit(A, "2024-02-01", coded=True)
    visit(A, "2024-08-01", coded=True)
    visit(B, "2024-02-01", coded=False)
    visit(B, "2024-08-01", coded=False)
    visit(D, "2024-05-01", coded=True, doctor=2)
    cover = [m for k in (A, B, D, E) for m in full_coverage(k)] + full_coverage(C, until=(2024, 3))
    tables = {
        "claim_line": claims(spark, lines),
        "dx_line": dx(spark, codes),
        "code_map": code_map(spark),
        "member_month": months(spark, cover),
        "member_death": spark.createDataFrame([(C, date(2024, 3, 10))], "member_id bigint, death_dt date"),
        "provider": spark.createDataFrame([(1, "PCP"), (2, "PCP")], "provider_id bigint, specialty_ctg_cd string"),
    }
    return Study(tables, params())


def test_verdicts(spark):
    rows = {r.member_id: (r.gate, r.carried_any) for r in build(spark).gates.collect()}
    assert rows == {
        A: (None, True),
        B: (None, False),
        C: ("death", False),
        D: ("changed_doctor", True),
        E: ("no_visit", False),
    }


def test_score_of_the_doctor(spark):
    scores = {r.provider_id: r for r in build(spark).scores.collect()}
    assert (scores[1].carried_same, scores[1].panel, scores[1].score_same) == (1, 2, 0.5)
    assert scores[1].panel_confirmed == 5


def test_attrition_adds_up(spark):
    rows = sorted(build(spark).attrition.collect(), key=lambda r: r.gate_order)
    assert [(r.gate, r.removed, r.remaining) for r in rows] == [
        ("confirmed", 0, 5),
        ("death", 1, 4),
        ("coverage", 0, 4),
        ("no_visit", 1, 3),
        ("changed_doctor", 1, 2),
    ]


def test_top_line_alone_hides_b(spark):
    study = build(spark, top_line_only=True)
    assert B not in {r.member_id for r in study.gates.collect()}
    score = {r.provider_id: r for r in study.scores.collect()}[1]
    assert (score.carried_same, score.panel) == (1, 1)


@pytest.mark.parametrize("unit, confirmed", [("date", 0), ("visit", 1)])
def test_two_visits_on_one_day(spark, unit, confirmed):
    lines = [line(1, A, "2023-02-01", doctor=1), line(2, A, "2023-02-01", doctor=2)]
    codes = [position(1, "01", "E11.9"), position(2, "01", "E11.9")]
    study = Study(
        {"claim_line": claims(spark, lines), "dx_line": dx(spark, codes), "code_map": code_map(spark)},
        params(mention_unit=unit),
    )
    assert study.outcome.count() == confirmed


def with_two_doctors(spark, source: str):
    """A sixth patient, who leaves doctor 1 after 2023 and keeps doctor 2; ``source`` of the line of 2024."""
    lines = [
        line(1, 6, "2023-02-01", doctor=1), line(2, 6, "2023-08-01", doctor=1), line(3, 6, "2023-09-01", doctor=2),
        line(4, 6, "2024-03-01", doctor=2),
    ]
    table = claims(spark, lines).withColumn("med_cost_ctg_cd", F.when(F.col("claim_line_id") == 4, source).otherwise("MED"))
    tables = {
        "claim_line": table,
        "dx_line": dx(spark, [position(k, "01", "E11.9", 6) for k in (1, 2, 3)]),
        "code_map": code_map(spark),
        "member_month": months(spark, full_coverage(6)),
        "provider": spark.createDataFrame([(1, "PCP"), (2, "PCP")], "provider_id bigint, specialty_ctg_cd string"),
    }
    return Study(tables, params().with_(excluded_sources=("LAB",)))


def test_a_doctor_is_not_judged_on_a_patient_who_left(spark):
    study = with_two_doctors(spark, "MED")
    assert [(r.gate, r.judged) for r in study.gates.collect()] == [(None, True)]
    panel = {r.provider_id: (r.panel_confirmed, r.panel) for r in study.scores.collect()}
    assert panel == {1: (1, 0), 2: (1, 1)}


def test_a_laboratory_is_not_the_doctor(spark):
    """Its line shows that the patient was seen, not that a doctor was kept."""
    assert [(r.gate, r.seen) for r in with_two_doctors(spark, "LAB").gates.collect()] == [("changed_doctor", True)]
