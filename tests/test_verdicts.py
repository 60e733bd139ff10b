"""Thresholds just below, at and above each bound; contract; the full run."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from carryover.operators import gates, measure, verdict
from carryover.plans.run import _blocking, run
from carryover.sources import conform, fixture_params, fixture_tables, load_tables, violations
from carryover.operators.profile import file_volume
from tests.conftest import SF_DIR

E = 1e-4


def verdicts(spark, values):
    df = spark.createDataFrame([(c, m, float(v)) for c, m, v in values], "check string, metric string, value double")
    return {(r.check, r.metric): r.verdict for r in verdict.metric_verdicts(df).collect()}


@pytest.mark.parametrize(
    "check, metric, at, below, equal, above",
    [
        ("V1", "max_position", 1, "FAIL", "FAIL", "PASS"),
        ("V2", "share_exactly_one", 0.90, "PASS", "PASS", "FAIL"),
        ("V3", "agreement", 0.95, "REVIEW", "REVIEW", "PASS"),
        ("V3", "agreement", 0.80, "FAIL", "REVIEW", "REVIEW"),
        ("V5", "share_full_present", 0.95, "REVIEW", "PASS", "PASS"),
        ("V5", "share_full_present", 0.85, "FAIL", "REVIEW", "REVIEW"),
        ("V6", "match_rate", 0.95, "REVIEW", "REVIEW", "PASS"),
        ("V6", "match_rate", 0.90, "FAIL", "REVIEW", "REVIEW"),
        ("V11", "share_unassigned", 0, "PASS", "PASS", "FAIL"),
        ("V11", "office_lead", 1, "FAIL", "REVIEW", "PASS"),
        ("V11", "share_disagree", 0.20, "REVIEW", "REVIEW", "FAIL"),
        ("V13", "codes_changed", 0, "PASS", "PASS", "FAIL"),
        ("V14", "difference", 0.05, "REVIEW", "PASS", "PASS"),
        ("V14", "z", 0, "FAIL", "FAIL", "REVIEW"),
        ("V17", "end_share", 0.25, "REVIEW", "REVIEW", "FAIL"),
        ("V17", "dip_share", 0.25, "PASS", "PASS", "REVIEW"),
        ("V19", "control_minus_main", 0.15, "REVIEW", "REVIEW", "FAIL"),
        ("V6", "member_mismatch", 0, "PASS", "PASS", "FAIL"),
        ("V7", "diff_pct_points", 0, "FAIL", "FAIL", "REVIEW"),
        ("V7", "diff_pct_points", 1, "REVIEW", "PASS", "PASS"),
        ("V8", "match_rate_by_code", 0.95, "REVIEW", "REVIEW", "PASS"),
        ("V8", "match_rate_by_code", 0.90, "FAIL", "REVIEW", "REVIEW"),
        ("EDA_0b", "max_rows_per_line", 1, "PASS", "PASS", "FAIL"),
        ("EDA_0c", "match_rate", 0.95, "FAIL", "PASS", "PASS"),
        ("EDA_1", "categories", 1, "FAIL", "PASS", "PASS"),
        ("V15", "largest_share_removed", 1 / 3, "PASS", "PASS", "REVIEW"),
        ("V16", "persistence", 0.50, "FAIL", "REVIEW", "REVIEW"),
        ("V16", "persistence", 0.65, "REVIEW", "PASS", "PASS"),
        ("V16", "persistence", 0.85, "PASS", "PASS", "REVIEW"),
        ("V16", "persistence", 0.95, "REVIEW", "REVIEW", "FAIL"),
    ],
)
def test_bounds(spark, check, metric, at, below, equal, above):
    got = [verdicts(spark, [(check, metric, v)])[check, metric] for v in (at - E, at, at + E)]
    assert got == [below, equal, above]


def test_missing_metric_is_unverifiable(spark):
    assert verdicts(spark, [("V1", "max_position", 5)])["V12", "excluded_lines"] == "UNVERIFIABLE"


def all_pass(spark):
    good = {"V16": 0.75}
    values = []
    for b in verdict.BOUNDS:
        values.append((b.check, b.metric, good.get(b.check, b.good + 1 if b.kind in ("above", "at_least") else 0)))
    return spark.createDataFrame([(c, m, float(v)) for c, m, v in values], "check string, metric string, value double")


def test_signoff_needs_people_and_every_gate_before(spark):
    metrics = all_pass(spark)
    open_ = {r.gate: (r.verdict, r.signed_off) for r in verdict.gate_signoff(metrics).collect()}
    assert open_ == {
        "1 foundation": ("PASS", True),
        "2 build": ("PASS", True),
        "3 plausibility": ("UNVERIFIABLE", False),
        "4 fairness": ("UNVERIFIABLE", False),
    }
    read = {"V18": "PASS", "V25": "PASS"}
    assert all(r.signed_off for r in verdict.gate_signoff(metrics, read).collect())
    broken = metrics.where("NOT (check = 'V3')")
    shut = {r.gate: r.signed_off for r in verdict.gate_signoff(broken, read).collect()}
    assert not any(shut.values())


def test_contract_reports_everything_at_once(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 1), "19.0")], "member_id bigint, death_dt date, x string")
    assert violations(df, "member_death") == []
    bad = df.select("x")
    assert violations(bad, "member_death") == ["member_death.member_id: missing", "member_death.death_dt: missing"]
    with pytest.raises(ValueError, match="member_id: missing; member_death.death_dt: missing"):
        conform(bad, "member_death")
    wrong = df.withColumn("death_dt", df.x)
    assert violations(wrong, "member_death") == ["member_death.death_dt: string is not a date"]


def test_conform_renames_and_settles_types(spark):
    df = spark.sql("SELECT 'E11.9' AS icd, 19.0D AS hcc_v24, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS extra")
    got = conform(df, "code_map", {"icd": "diagnosis_code"})
    assert got.columns == ["diagnosis_code", "hcc_v24"]
    assert got.first().hcc_v24 == "19"
    dead = spark.sql("SELECT 1L AS member_id, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS death_dt")
    assert conform(dead, "member_death").first().death_dt == date(2024, 1, 1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    tables = fixture_tables(spark, "/root/testdata/sf0.001")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    return {n: f"{folder}/{n}" for n in tables}


def test_load_tables(spark, stored):
    tables = load_tables(spark, stored)
    assert tables["claim_line"].count() == 1500
    with pytest.raises(ValueError, match="no such table.*|missing"):
        load_tables(spark, {"nothing": "/x", "dx_line": stored["provider"]})


def test_file_volume(spark, stored):
    rows = file_volume(spark, {n: stored[n] for n in ("claim_line", "dx_line")}).collect()
    assert [r.table_name for r in rows] == ["claim_line", "dx_line"]
    assert all(r.last_modified is not None and r.size_gb == 0.0 for r in rows)


def histogram(spark, counts, zero=0, hundred=0):
    rows = [("b", "c", i, n, zero if i == 0 else 0, hundred if i == 19 else 0) for i, n in counts.items()]
    return spark.createDataFrame(rows, "book string, condition string, bucket int, doctors long, at_zero long, at_hundred long")


@pytest.mark.parametrize(
    "counts, dip",
    [
        ({5: 2, 6: 10, 7: 20, 8: 12, 9: 1}, 0.0),  # one peak with tails
        ({2: 20, 3: 10, 4: 20}, 0.5),
        ({2: 20, 9: 10}, 1.0),  # two humps with nothing in between
        ({0: 7}, 0.0),
        ({3: 40, 4: 30, 5: 36, 6: 9}, 0.1667),  # a dent, held against the lower hump
    ],
)
def test_score_shape(spark, counts, dip):
    row = gates.score_shape(histogram(spark, counts, zero=1, hundred=2)).first()
    assert row.dip_share == dip and row.doctors == sum(counts.values())
    ends = (0 in counts) + 2 * (19 in counts)
    assert row.end_share == round(ends / row.doctors, 4)


def test_two_mention_test(spark):
    rows = [("b", "c", "confirmed", 400, 320), ("b", "c", "too few mentions", 100, 60), ("b", "d", "confirmed", 5, 5)]
    df = spark.createDataFrame(rows, "book string, condition string, mention_group string, members long, carried_any long")
    got = {r.condition: (r.difference, r.z) for r in gates.two_mention_test(df).collect()}
    pooled = 380 / 500
    z = 0.2 / (pooled * (1 - pooled) * (1 / 400 + 1 / 100)) ** 0.5
    assert got["c"] == (0.2, round(z, 4))
    assert got["d"] == (None, None)


def test_setting_summary(spark):
    rows = [("b", "office", "PCP", 60), ("b", "inpatient", "PCP", 10), ("b", "inpatient", "LABS", 30), ("b", "unassigned", "(none)", 20), ("e", "inpatient", "LABS", 5)]
    cells = spark.createDataFrame(rows, "book string, setting string, specialty string, n_rows long")
    p = fixture_params()
    got = {r.book: r for r in gates.setting_summary(cells, p).collect()}
    assert (got["b"].share_unassigned, got["b"].office_lead, got["b"].share_disagree) == (0.1667, 1.5, 0.1429)
    assert (got["e"].office_lead, got["e"].share_disagree) == (0.0, None)
    assert {r.share_disagree for r in gates.setting_summary(cells, p.with_(specialty_settings={})).collect()} == {None}


def test_control_difference_has_an_interval(spark):
    rows = [("b", "diabetes", True, i < 70) for i in range(100)] + [("b", "control", True, i < 45) for i in range(50)]
    df = spark.createDataFrame(rows, "book string, condition string, judged boolean, carried_any boolean")
    row = gates.control_condition(df, fixture_params()).first()
    spread = 1.959963984540054 * (0.9 * 0.1 / 50 + 0.7 * 0.3 / 100) ** 0.5
    assert row.control_minus_main == 0.2
    assert (row.difference_low, row.difference_high) == (round(0.2 - spread, 4), round(0.2 + spread, 4))


def test_the_first_gate_stops_unless_it_passed_or_was_let_through(spark):
    rows = [("V1", "PASS", True), ("V3", "REVIEW", True), ("V6", "UNVERIFIABLE", True), ("V7", "PASS", True), ("V8", "FAIL", False), ("EDA_1", "FAIL", True), ("V4", "REVIEW", False)]
    df = spark.createDataFrame(rows, "check string, verdict string, blocks boolean")
    assert _blocking(df) == ("EDA_1", "V3", "V6")
    assert _blocking(df, ("V3", "EDA_1")) == ("V6",)


def test_run_stops_at_a_blocking_check_and_goes_on_when_told(spark, stored, tmp_path):
    tables = load_tables(spark, stored)
    p = fixture_params().with_(min_panel=2, sensitivity_panels=(1, 2))
    stopped = run(spark, tables, p, str(tmp_path / "stopped"))
    assert "V3" in stopped.stopped_by
    assert not (tmp_path / "stopped" / "gate_signoff.parquet").exists()
    done = run(spark, tables, p, str(tmp_path / "done"), stop=False)
    assert {r.gate for r in done.verdicts.collect()} == set(verdict.GATE_CHECKS)
    for name in ("v7_diabetes_share", "ranking", "v24_sensitivity", "check_verdicts"):
        assert (tmp_path / "done" / f"{name}.parquet").exists()
        assert (tmp_path / "done" / f"{name}.csv").exists()


def test_nothing_passes_for_want_of_data(spark, stored):
    """Without books no line is in scope: gates 2 to 4 have nothing to pass on."""
    from carryover.params import Params
    from carryover.plans.study import Study

    p = fixture_params()
    empty = Params(y1=p.y1, y2=p.y2, settings=p.settings)
    study = Study(load_tables(spark, stored), empty)
    metrics = study.build_metrics(study.build()).unionByName(study.figure_metrics(study.figures()))
    later = {r.verdict for r in verdict.metric_verdicts(metrics).collect() if r.check not in verdict.FOUNDATION_CHECKS}
    assert later == {"UNVERIFIABLE"}


def test_the_curated_extract_meets_its_contract(spark):
    t, p = fixture_tables(spark, SF_DIR), fixture_params()
    built = measure.curate_claims(t["claim_line"], t["member_month"], t["provider"], p)
    columns = conform(built, "curated_claims").columns
    assert "prvdr_submarket" in columns
    named = t["provider"].withColumn("prvdr_submarket", F.lit("S1"))
    values = measure.curate_claims(t["claim_line"], t["member_month"], named, p).select("prvdr_submarket").distinct()
    assert {r[0] for r in values.collect()} <= {"S1", None}
