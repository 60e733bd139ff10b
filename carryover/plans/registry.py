"""Every operator as a named query over the test tables of one scale."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from carryover.operators import checks, codes, coverage, declared, doctors, gates, linked, measure, profile, verdict
from carryover.params import Params
from carryover.plans.stages import StageStore
from carryover.plans.study import Study
from carryover.sources.fixtures import fixture_params, fixture_tables, hot_line_tables
from carryover.sources.prepared import Prepared, write_prepared

Tables = Mapping[str, DataFrame]
Query = Callable[[SparkSession, str], DataFrame]

P = fixture_params()
INPUTS = (
    "dx_line", "claim_line", "code_map", "member_month", "provider", "curated_claims", "chronic_ref",
)

# keys that the test tables number one after another
DENSE_KEYS = ("claim_line_id", "member_id", "srv_prvdr_id", "provider_id")


def _query(build: Callable[[Tables, Params], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(fixture_tables(spark, sf_dir), P)

    return run


DISCOVERY = {
    "column_profile": lambda t, p: profile.column_profiles({n: t[n] for n in INPUTS}, dense_keys=DENSE_KEYS),
    "table_volume": lambda t, p: profile.table_volume({n: t[n] for n in INPUTS}),
    "curated_column_profile": lambda t, p: profile.column_listing(t["curated_claims"], "curated_claims"),
    "curated_table_volume": lambda t, p: profile.table_volume({"curated_claims": t["curated_claims"]}),
    "profile_plc_srv_cd": lambda t, p: profile.value_profile(t["claim_line"], "claim_line", ["plc_srv_cd"]),
    "profile_plc_srv_ctg_cd": lambda t, p: profile.value_profile(t["claim_line"], "claim_line", ["plc_srv_ctg_cd"]),
    "profile_med_cost_ctg_cd": lambda t, p: profile.value_profile(t["claim_line"], "claim_line", ["med_cost_ctg_cd"]),
    "profile_poa_cd": lambda t, p: profile.value_profile(t["dx_line"], "dx_line", ["poa_cd"]),
    "profile_mbr_state": lambda t, p: profile.value_profile(t["member_month"], "member_month", ["mbr_state"]),
    "profile_specialty_ctg_cd": lambda t, p: profile.value_profile(t["provider"], "provider", ["specialty_ctg_cd"]),
    "value_profile": lambda t, p: profile.value_profile(
        t["claim_line"], "claim_line", ["plc_srv_cd", "plc_srv_ctg_cd", "med_cost_ctg_cd"]
    ),
    "eda_grain_distribution": lambda t, p: profile.grain_distribution(t["curated_claims"]),
    "eda_grain_totals": lambda t, p: profile.grain_totals(t["curated_claims"]),
    "eda_dx_probe": lambda t, p: profile.dx_probe(t["curated_claims"], t["dx_line"], p),
    "eda_business_line": lambda t, p: profile.business_lines(t["curated_claims"]),
    "eda_submarket_cardinality": lambda t, p: profile.submarket_cardinality(t["curated_claims"]),
    "eda_submarket_top10": lambda t, p: profile.submarket_top(t["curated_claims"]),
    "eda_year_range": lambda t, p: profile.year_range(t["curated_claims"]),
    "eda_dm_codes": lambda t, p: codes.category_examples(t["code_map"], p.families["diabetes"], raw=False),
}

FOUNDATION = {
    "v1_sequence_values": lambda t, p: checks.sequence_values(t["dx_line"]),
    "v2_dx_per_line_summary": lambda t, p: checks.dx_per_line_summary(t["dx_line"]),
    "v2_dx_per_line_distribution": lambda t, p: checks.dx_per_line_distribution(t["dx_line"]),
    "v3_seq1_agreement": lambda t, p: checks.first_position_agreement(t["claim_line"], t["dx_line"]),
    "v3_disagreeing_pairs": lambda t, p: checks.disagreeing_pairs(t["claim_line"], t["dx_line"]),
    "v4_monthly_volume": lambda t, p: checks.monthly_volume(t["claim_line"], p),
    "v4_q4_ratio": lambda t, p: checks.q4_ratio(t["claim_line"], p),
    "v5_membership_grain": lambda t, p: checks.membership_grain(t["member_month"], p),
    "v5_presence_pivot": lambda t, p: checks.presence_pivot(t["member_month"], p),
    "v5_claims_vs_coverage": lambda t, p: checks.claims_vs_coverage(t["claim_line"], t["member_month"], p),
    "v6_join_integrity": lambda t, p: checks.join_integrity(t["claim_line"], t["dx_line"], p),
    "v6_mismatch_sample": lambda t, p: checks.mismatch_sample(t["claim_line"], t["dx_line"], p),
    "v7_diabetes_codes": lambda t, p: codes.category_examples(t["code_map"], p.families["diabetes"], raw=True),
    "v8_code_shapes": lambda t, p: profile.code_shapes(t["dx_line"], t["code_map"]),
    "v8_match_rate": lambda t, p: checks.match_rate(t["dx_line"], t["code_map"]),
    "v8_unmatched_codes": lambda t, p: checks.unmatched_codes(t["dx_line"], t["code_map"]),
}

UNIT_ = ("book", "condition", "member_id")

# Each takes a Study; its stages are lazy and shared within one query.
MEASURE = {
    "v7_diabetes_share": lambda s: checks.recorded_share(
        s.t["claim_line"], s.t["dx_line"], s.t["member_month"], s.diabetes, s.p
    ),
    "chronic_share": lambda s: checks.recorded_share(
        s.t["claim_line"], s.t["dx_line"], s.t["member_month"], s.chronic, s.p, "chronic"
    ),
    "curate_claims": lambda s: measure.curate_claims(s.t["claim_line"], s.t["member_month"], s.t["provider"], s.p),
    "build_member_month": lambda s: coverage.build_member_month(s.t["member_raw"], s.p),
    "scope_claims": lambda s: measure.scope_claims(s.t["claim_line"], s.p).select(
        "claim_line_id", "member_id", "srv_start_dt", "business_ln_cd", "book"
    ),
    "expand_positions": lambda s: measure.expand_positions(
        checks.two_years(s.t["claim_line"], s.p).select("claim_line_id", "member_id", "srv_start_dt", "plc_srv_cd"),
        s.t["dx_line"],
    ),
    "label_conditions": lambda s: measure.label_conditions(
        measure.expand_positions(
            checks.two_years(s.t["claim_line"], s.p).select("claim_line_id", "member_id"), s.t["dx_line"]
        ),
        s.labels,
        s.p,
    ).select("claim_line_id", "member_id", "position", "code", "condition", "category"),
    "classify_setting": lambda s: measure.classify_setting(s.t["claim_line"], s.p).select(
        "claim_line_id", "plc_srv_cd", "setting"
    ),
    "exclude_sources": lambda s: measure.exclude_sources(s.t["claim_line"], s.p).select(
        "claim_line_id", "med_cost_ctg_cd"
    ),
    "condition_records": lambda s: s.records,
    "confirm_two_mentions": lambda s: measure.confirm_mentions(s.summary, s.p),
    "confirm_two_visits": lambda s: measure.confirm_mentions(
        measure.member_summary(s.records, s.p.with_(mention_unit="visit")), s.p
    ),
    "member_year": lambda s: s.member_years,
    "hospital_sustained": lambda s: measure.hospital_sustained(s.member_years),
    "two_year_outcome": lambda s: s.outcome,
    "gate_death": lambda s: measure.gate_death(s.outcome, s.t["member_death"], s.p).select(*UNIT_, "alive"),
    "gate_coverage": lambda s: measure.gate_coverage(s.outcome, s.t["member_month"], s.p).select(
        *UNIT_, "months", "covered"
    ),
    "gate_same_doctor": lambda s: measure.gate_contact(s.outcome, s.t["claim_line"], s.p).select(
        *UNIT_, "same_doctor"
    ),
    "flag_no_visit": lambda s: measure.gate_contact(s.outcome, s.t["claim_line"], s.p).select(
        *UNIT_, "lines", "seen"
    ),
    "gate_code_family": lambda s: measure.code_moves(s.records, s.outcome, s.p),
    "gated_outcome": lambda s: s.gates,
    "attrition": lambda s: s.attrition,
    "condition_incidence": lambda s: measure.condition_incidence(
        s.summary, s.t["claim_line"], s.t["member_month"], s.p
    ),
}

DOCTORS = {
    "provider_scores": lambda s: s.scores,
    "min_panel": lambda s: doctors.min_panel(s.scores, s.p),
    "shrink_scores": lambda s: doctors.shrink_scores(s.scores, s.p),
    "peer_compare": lambda s: doctors.peer_compare(s.standardised),
    "rank_scores": lambda s: doctors.ranking(s.ranked),
    "case_timelines": lambda s: s.histories(("lowest",), s.p.case_members),
}

GATES = {
    "v9_stage_reconcile": lambda s: gates.stage_reconcile(
        s.t["claim_line"], s.t["dx_line"], s.records, s.gates, s.p
    ),
    "v10_collapse_unique": lambda s: gates.collapse_unique(s.member_years, s.records),
    "v11_setting_agreement": lambda s: gates.setting_agreement(s.t["claim_line"], s.t["provider"], s.p),
    "v11_setting_summary": lambda s: gates.setting_summary(
        gates.setting_agreement(s.t["claim_line"], s.t["provider"], s.p), s.p
    ),
    "v12_excluded_absent": lambda s: gates.excluded_absent(s.records, s.t["claim_line"], s.p),
    "v13_retired_codes": lambda s: s.retired_codes(),
    "v14_two_mention_effect": lambda s: gates.two_mention_effect(s.summary, s.p),
    "v14_two_mention_test": lambda s: gates.two_mention_test(gates.two_mention_effect(s.summary, s.p)),
    "v15_gate_removal": lambda s: gates.gate_removal(s.attrition),
    "v16_population_rate": lambda s: gates.population_rate(s.gates, s.p),
    "v17_score_distribution": lambda s: gates.score_distribution(s.scores, s.p),
    "v17_score_shape": lambda s: gates.score_shape(gates.score_distribution(s.scores, s.p)),
    "v18_extreme_histories": lambda s: s.histories(("lowest", "highest"), s.p.extreme_members),
    "v19_control_condition": lambda s: gates.control_condition(s.gates, s.p),
    "v20_office_vs_any": lambda s: gates.office_vs_any(s.scores),
    "v21_books_separate": lambda s: gates.books_separate(s.records, s.gates, s.p),
    "v22_flag_survival": lambda s: doctors.flag_survival(s.ranked, s.p),
    "final_list": lambda s: doctors.final_list(doctors.flag_survival(s.ranked, s.p)),
    "v23_covariate_balance": lambda s: gates.covariate_balance(s.panel, s.ranked, s.age, s.burden),
    "v24_sensitivity": lambda s: s.sensitivity(),
    "v26_attach_limits": lambda s: gates.attach_limits(s.gates),
    "figure_limits": lambda s: declared.limits_of(s.t["claim_line"].sparkSession, s.figures()),
    "results_checked": lambda s: declared.results_checked(s.figures(), s.books_recorded(), s.p),
    "batch_submission_shape": lambda s: gates.batch_submission_shape(
        s.t["claim_line"], s.t["dx_line"], s.diabetes, s.p
    ),
    "foundation_verdicts": lambda s: verdict.metric_verdicts(
        s.foundation_metrics(s.foundation()), verdict.FOUNDATION_CHECKS
    ),
    "check_verdicts": lambda s: verdict.check_verdicts(s.metrics()),
    "gate_signoff": lambda s: verdict.gate_signoff(s.metrics()),
}


# Queries that read a stage more than once; the others pass through lazily.
REUSING = {
    *DOCTORS,
    "gate_code_family",
    "v9_stage_reconcile",
    "v17_score_distribution",
    "v17_score_shape",
    "v18_extreme_histories",
    "v20_office_vs_any",
    "v21_books_separate",
    "v22_flag_survival",
    "final_list",
    "v23_covariate_balance",
    "v24_sensitivity",
    "v10_collapse_unique",
    "figure_limits",
    "results_checked",
    "check_verdicts",
    "gate_signoff",
}


# What joins on the line id, over prepared tables in which a third of the rows of each lie on one line.
LINKED = {
    "linked_seq1_agreement": lambda t, s: linked.first_position_agreement(t),
    "linked_disagreeing_pairs": lambda t, s: linked.disagreeing_pairs(t),
    "linked_join_integrity": lambda t, s: linked.join_integrity(t, s.p),
    "linked_diabetes_share": lambda t, s: linked.recorded_share(t, s.t["member_month"], s.diabetes, s.p),
    "linked_expand_positions": lambda t, s: linked.expand_positions(t, s.p).select(
        "claim_line_id", "member_id", "srv_start_dt", "plc_srv_cd", "position", "code"
    ),
    "linked_condition_records": lambda t, s: linked.condition_records(t, s.labels, s.p),
}
#: Rows above which a line of the test tables is kept apart, and the buckets of the rest.
HOT_ROWS, BUCKETS = 1_000, 16


def _linked(build: Callable[[Prepared, Study], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = StageStore.of(spark)
        tables = hot_line_tables(spark, sf_dir)
        prepared = write_prepared(
            tables["claim_line"], tables["dx_line"], "claim_line_id", f"linked_{uuid.uuid4().hex}",
            buckets=BUCKETS, hot_rows=HOT_ROWS, folder=store.path if store else None,
        )
        return build(prepared, Study(tables, P, None, store))

    return run


def _study(build: Callable[[Study], DataFrame], *, staged: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = StageStore.of(spark)
        return build(Study(fixture_tables(spark, sf_dir), P, store if staged else None, store))

    return run


QUERIES: dict[str, Query] = {
    **{name: _query(build) for group in (DISCOVERY, FOUNDATION) for name, build in group.items()},
    **{name: _study(build, staged=name in REUSING) for group in (MEASURE, DOCTORS, GATES) for name, build in group.items()},
    **{name: _linked(build) for name, build in LINKED.items()},
}
