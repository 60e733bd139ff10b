"""One study: the tables, the choices, and every stage derived from them.

Stages are lazy.  With a :class:`~carryover.plans.stages.StageStore` those that
are used several times - condition records, gated outcomes, panels, doctor
scores - are written once and read back, which cuts the lineage where the data
has become small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.operators import checks, codes, declared, doctors, gates, measure, profile, verdict
from carryover.lazy import Lazy
from carryover.params import Params
from carryover.plans.stages import StageStore


class Study:
    """``store`` keeps the stages; ``lookups`` (by default the same) the small code tables,
    which are worth writing also where nothing else is: the planner broadcasts a file it
    knows to be small, and large tables then meet it in their scan stage."""

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        p: Params,
        store: StageStore | None = None,
        lookups: StageStore | None = None,
    ):
        self.t = tables
        self.p = p
        self._store = store
        self._lookups = lookups or store

    def _stage(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        return df if self._store is None else self._store.keep(name, df, *by)

    def _lookup(self, name: str, df: DataFrame) -> DataFrame:
        return df if self._lookups is None else self._lookups.keep(name, df.coalesce(1))

    # --- code lookups -----------------------------------------------------

    @cached_property
    def labels(self) -> DataFrame:
        """(condition, category, code) of every family."""
        return self._lookup("labels", codes.family_codes(self.t["code_map"], self.p.families))

    @cached_property
    def categories(self) -> DataFrame:
        """Distinct (code, category)."""
        return self._lookup("categories", codes.code_categories(self.t["code_map"]))

    @cached_property
    def diabetes(self) -> DataFrame:
        """Distinct codes of the main condition."""
        return self._lookup("main_codes", codes.code_set(self.t["code_map"], self.p.families[self.p.main_family]))

    @cached_property
    def chronic(self) -> DataFrame:
        """Distinct codes of the long-term condition reference."""
        return self._lookup("chronic_codes", codes.chronic_codes(self.t["chronic_ref"]))

    # --- stages -----------------------------------------------------------

    @cached_property
    def records(self) -> DataFrame:
        t = self.t
        return self._stage(
            "records",
            measure.labelled(t["claim_line"], t["dx_line"], self.labels, self.p),
            "condition",
            "yr",
        )

    @cached_property
    def main_records(self) -> DataFrame:
        return self.records.where(F.col("condition") == self.p.main_family)

    @cached_property
    def member_years(self) -> DataFrame:
        return measure.member_year(self.records)

    @cached_property
    def summary(self) -> DataFrame:
        return measure.member_summary(self.records, self.p)

    @cached_property
    def outcome(self) -> DataFrame:
        return measure.two_year_outcome(self.summary, self.p)

    def _gated(self, outcome: DataFrame) -> DataFrame:
        t = self.t
        return measure.gated(
            outcome, t["claim_line"], t["member_month"], t.get("member_death"), self.p
        )

    @cached_property
    def all_gates(self) -> DataFrame:
        """Gates for every unit that some mention rule in use would confirm."""
        loosest = min(self.p.mentions, *self.p.sensitivity_mentions)
        return self._stage("gates", self._gated(measure.two_year_outcome(self.summary, self.p, loosest)))

    @cached_property
    def gates(self) -> DataFrame:
        return self.all_gates.where(F.col("mentions") >= self.p.mentions)

    @cached_property
    def attrition(self) -> DataFrame:
        return measure.attrition(self.gates)

    @cached_property
    def all_panels(self) -> DataFrame:
        return self._stage("panels", doctors.panels(self.all_gates, self.records, self.t["claim_line"], self.p))

    @cached_property
    def panel(self) -> DataFrame:
        return self.all_panels.where(F.col("mentions") >= self.p.mentions)

    @cached_property
    def scores(self) -> DataFrame:
        return self._stage("scores", doctors.provider_scores(self.panel, self.t["provider"], self.p))

    @cached_property
    def age(self) -> DataFrame:
        return measure.member_age(self.t["member_month"], self.p)

    @cached_property
    def burden(self) -> DataFrame:
        t = self.t
        return measure.member_burden(t["claim_line"], t["dx_line"], self.categories, self.p)

    @cached_property
    def all_standardised(self) -> DataFrame:
        """Every doctor, counted and standardised under each mention rule in use."""
        df = doctors.standardised(self.all_panels, self.t["provider"], self.age, self.burden, self.p)
        return self._stage("standardised", df)

    @cached_property
    def standardised(self) -> DataFrame:
        return doctors.under_rule(self.all_standardised, self.p.mentions)

    @cached_property
    def ranked(self) -> DataFrame:
        return self._stage("ranked", doctors.rank_scores(self.standardised, self.p))

    # --- figures that need several stages ------------------------------------

    def sensitivity(self) -> DataFrame:
        return gates.sensitivity(self.all_standardised, self.p)

    def retired_codes(self) -> DataFrame:
        t = self.t
        return gates.retired_codes(
            t["claim_line"], t["dx_line"], t["code_map"], self.diabetes, self.p, t.get("code_version")
        )

    def histories(self, ends: tuple[str, ...], members: int) -> DataFrame:
        t, p = self.t, self.p
        visits = doctors.picked_visits(
            self.panel, self.ranked, t["claim_line"], p, ends=ends, members=members
        )
        visits = self._stage("visits_" + "_".join(ends), visits)
        return doctors.histories(visits, t["dx_line"], self.diabetes)

    # --- results, by gate -----------------------------------------------------

    def foundation(self) -> Lazy:
        """Discovery and the eight foundation checks."""
        t, p = self.t, self.p
        claim, dx, months, curated = (t[n] for n in ("claim_line", "dx_line", "member_month", "curated_claims"))
        pattern = p.families[p.main_family]
        return Lazy({
            "grain_distribution": lambda: profile.grain_distribution(curated),
            "grain_totals": lambda: profile.grain_totals(curated),
            "dx_probe": lambda: profile.dx_probe(curated, dx, p),
            "business_line": lambda: profile.business_lines(curated),
            "submarket_cardinality": lambda: profile.submarket_cardinality(curated),
            "submarket_top10": lambda: profile.submarket_top(curated),
            "year_range": lambda: profile.year_range(curated),
            "dm_codes": lambda: codes.category_examples(t["code_map"], pattern, raw=False),
            "claim_line_values": lambda: profile.value_profile(
                claim, "claim_line", ["plc_srv_cd", "plc_srv_ctg_cd", "med_cost_ctg_cd"]
            ),
            "dx_line_values": lambda: profile.value_profile(dx, "dx_line", ["poa_cd"]),
            "member_month_values": lambda: profile.value_profile(months, "member_month", ["mbr_state"]),
            "provider_values": lambda: profile.value_profile(t["provider"], "provider", ["specialty_ctg_cd"]),
            "v1_sequence_values": lambda: checks.sequence_values(dx),
            "v2_dx_per_line_summary": lambda: checks.dx_per_line_summary(dx),
            "v2_dx_per_line_distribution": lambda: checks.dx_per_line_distribution(dx),
            "v3_seq1_agreement": lambda: checks.first_position_agreement(claim, dx),
            "v3_disagreeing_pairs": lambda: checks.disagreeing_pairs(claim, dx),
            "v4_monthly_volume": lambda: checks.monthly_volume(claim, p),
            "v4_q4_ratio": lambda: checks.q4_ratio(claim, p),
            "v5_membership_grain": lambda: checks.membership_grain(months, p),
            "v5_presence_pivot": lambda: checks.presence_pivot(months, p),
            "v5_claims_vs_coverage": lambda: checks.claims_vs_coverage(claim, months, p),
            "v6_join_integrity": lambda: checks.join_integrity(claim, dx, p),
            "v6_mismatch_sample": lambda: checks.mismatch_sample(claim, dx, p),
            "v7_diabetes_codes": lambda: codes.category_examples(t["code_map"], pattern, raw=True),
            "v7_diabetes_share": lambda: checks.recorded_share(claim, dx, months, self.diabetes, p),
            **self._chronic_arm(),
            "v8_code_shapes": lambda: profile.code_shapes(dx, t["code_map"]),
            "v8_match_rate": lambda: checks.match_rate(dx, t["code_map"]),
            "v8_unmatched_codes": lambda: checks.unmatched_codes(dx, t["code_map"]),
        })

    def _chronic_arm(self) -> dict:
        """V7 once more over every long-term condition, where its reference is given."""
        if self.t.get("chronic_ref") is None:
            return {}
        t = self.t
        return {
            "chronic_share": lambda: checks.recorded_share(
                t["claim_line"], t["dx_line"], t["member_month"], self.chronic, self.p, "chronic"
            )
        }

    def build(self) -> Lazy:
        """Gate 2; without exclusion values V12 cannot be computed."""
        t, p = self.t, self.p
        out = {
            "v9_stage_reconcile": lambda: gates.stage_reconcile(t["claim_line"], t["dx_line"], self.records, self.gates, p),
            "v10_collapse_unique": lambda: gates.collapse_unique(self.member_years, self.records),
            "v11_setting_agreement": lambda: gates.setting_agreement(t["claim_line"], t["provider"], p),
            "v11_setting_summary": lambda: gates.setting_summary(
                gates.setting_agreement(t["claim_line"], t["provider"], p), p
            ),
            "v13_retired_codes": lambda: self.retired_codes(),
            "v14_two_mention_effect": lambda: gates.two_mention_effect(self.summary, p),
            "v14_two_mention_test": lambda: gates.two_mention_test(gates.two_mention_effect(self.summary, p)),
            "v15_gate_removal": lambda: gates.gate_removal(self.attrition),
            "hospital_sustained": lambda: measure.hospital_sustained(self.member_years),
            "code_moves": lambda: measure.code_moves(self.records, self.outcome, p),
            "batch_submission_shape": lambda: gates.batch_submission_shape(t["claim_line"], t["dx_line"], self.diabetes, p),
        }
        if p.excluded_sources:
            out["v12_excluded_absent"] = lambda: gates.excluded_absent(self.records, t["claim_line"], p)
        return Lazy(out)

    def figures(self) -> Lazy:
        """Doctor scores and gates 3 and 4."""
        t, p = self.t, self.p
        out = {
            "condition_incidence": lambda: measure.condition_incidence(
                self.summary, t["claim_line"], t["member_month"], p
            ),
            "provider_scores": lambda: doctors.min_panel(self.scores, p),
            "ranking": lambda: doctors.ranking(self.ranked),
            "peer_compare": lambda: doctors.peer_compare(self.standardised),
            "case_timelines": lambda: self.histories(("lowest",), p.case_members),
            "v16_population_rate": lambda: gates.population_rate(self.gates, p),
            "v17_score_distribution": lambda: gates.score_distribution(self.scores, p),
            "v17_score_shape": lambda: gates.score_shape(gates.score_distribution(self.scores, p)),
            "v18_extreme_histories": lambda: self.histories(("lowest", "highest"), p.extreme_members),
            "v20_office_vs_any": lambda: gates.office_vs_any(self.scores),
            "v21_books_separate": lambda: gates.books_separate(self.records, self.gates, p),
            "v22_flag_survival": lambda: doctors.flag_survival(self.ranked, p),
            "final_list": lambda: doctors.final_list(doctors.flag_survival(self.ranked, p)),
            "v23_covariate_balance": lambda: gates.covariate_balance(self.panel, self.ranked, self.age, self.burden),
            "v24_sensitivity": lambda: self.sensitivity(),
            "v26_attach_limits": lambda: gates.attach_limits(self.gates),
        }
        if p.control_family:
            out["v19_control_condition"] = lambda: gates.control_condition(self.gates, p)
        limited = {n: partial(self._limited, n, make) for n, make in out.items()}
        return Lazy(limited)

    @staticmethod
    def _limited(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return declared.with_limits(make(), name)

    def books_recorded(self) -> DataFrame:
        """Books with a record of the main condition."""
        return self.gates.where(F.col("condition") == self.p.main_family).where("judged").select("book").distinct()

    # --- metrics ----------------------------------------------------------------

    def foundation_metrics(self, results: Mapping[str, DataFrame]) -> DataFrame:
        y1, y2 = self.p.years
        pair = (F.col("year_1") == y1) & (F.col("year_2") == y2)
        r, rows = results, verdict.metric_rows
        return _union(
            [
                rows(
                    r["grain_distribution"].agg(F.max("rows_per_claim_line_id").alias("m")),
                    "EDA_0b",
                    {"max_rows_per_line": "m"},
                ),
                rows(r["dx_probe"], "EDA_0c", _same("match_rate", "lines_member_disagree")),
                rows(r["dm_codes"].agg(F.count(F.lit(1)).alias("m")), "EDA_1", {"categories": "m"}),
                rows(r["v1_sequence_values"].agg(F.max("sequence_id").alias("m")), "V1", {"max_position": "m"}),
                rows(
                    r["v2_dx_per_line_summary"],
                    "V2",
                    _same("share_exactly_one", "avg_dx_per_claim_line", "share_over_ten"),
                ),
                rows(r["v3_seq1_agreement"], "V3", _same("agreement")),
                rows(
                    r["v4_q4_ratio"].agg(F.count_if(pair & F.col("within_10pct")).alias("m")),
                    "V4",
                    {"within_10pct": "m"},
                ),
                rows(r["v5_presence_pivot"], "V5", {"share_full_present": f"share_full_{y1}_present_{y2}"}),
                rows(r["v6_join_integrity"], "V6", _same("match_rate", "member_mismatch", "multi_member_lines")),
                rows(r["v7_diabetes_share"], "V7", _same("diff_pct_points")),
                rows(r["v8_match_rate"], "V8", _same("match_rate_by_code")),
            ]
        )

    def build_metrics(self, results: Mapping[str, DataFrame]) -> DataFrame:
        r, rows = results, verdict.metric_rows
        main = F.col("condition") == self.p.main_family
        parts = [
            rows(
                r["v9_stage_reconcile"].agg(_count_of(~F.col("accounted_for")).alias("m")),
                "V9",
                {"stages_not_accounted_for": "m"},
            ),
            rows(
                r["v10_collapse_unique"],
                "V10",
                {
                    c: F.when(F.col("member_years") > 0, F.col(c)) for c in ("repeated_keys", "lost_or_invented_keys")
                },
            ),
            rows(
                r["v15_gate_removal"].where(main).agg(F.max("share_removed").alias("m")),
                "V15",
                {"largest_share_removed": "m"},
            ),
        ]
        parts += [
            rows(
                r["v11_setting_summary"].agg(
                    *[F.max(c).alias(c) for c in ("share_unassigned", "share_disagree")], F.min("office_lead").alias("office_lead")
                ),
                "V11",
                _same("share_unassigned", "office_lead", "share_disagree"),
            ),
            # without dated code lists no status is known, and nothing is shown to be unchanged
            rows(
                r["v13_retired_codes"].agg(
                    F.when(F.count("change") > 0, F.count_if(F.col("change") != "unchanged")).alias("m")
                ),
                "V13",
                {"codes_changed": "m"},
            ),
            rows(
                r["v14_two_mention_test"].where(main).agg(*[F.min(c).alias(c) for c in ("difference", "z")]),
                "V14",
                _same("difference", "z"),
            ),
        ]
        if "v12_excluded_absent" in r:
            left = F.when(F.col("measured_lines") > 0, F.col("excluded_lines"))
            parts.append(rows(r["v12_excluded_absent"], "V12", {"excluded_lines": left}))
        return _union(parts)

    def figure_metrics(self, results: Mapping[str, DataFrame]) -> DataFrame:
        """Of several books the one furthest from passing counts."""
        r, rows = results, verdict.metric_rows
        main = F.col("condition") == self.p.main_family
        rate = F.col("persistence_any")

        def one(name: str, value, check: str, metric: str) -> DataFrame:
            df = r[name]
            if "condition" in df.columns:
                df = df.where(main)
            return rows(df.agg(value.alias("m")), check, {metric: "m"})

        control = []
        if "v19_control_condition" in r:
            worst = [F.max(c).alias(c) for c in ("control_minus_main", "difference_high")]
            control = [rows(r["v19_control_condition"].agg(*worst), "V19", _same("control_minus_main", "difference_high"))]
        return _union(
            [
                *control,
                rows(
                    r["v17_score_shape"].where(main).agg(*[F.max(c).alias(c) for c in ("end_share", "dip_share")]),
                    "V17",
                    _same("end_share", "dip_share"),
                ),
                one("v16_population_rate", F.max_by(rate, F.abs(rate - 0.75)), "V16", "persistence"),
                rows(
                    r["v20_office_vs_any"].agg(F.sum("office_above_any").alias("m")), "V20", {"office_above_any": "m"}
                ),
                self._read_back(r),
                rows(
                    doctors.unsupported(r["final_list"], r["v22_flag_survival"], r["ranking"]),
                    "V22",
                    _same("unsupported", "left_out"),
                ),
                one("v23_covariate_balance", F.max(F.abs("standardised_difference")), "V23", "largest_difference"),
                one("v24_sensitivity", F.min("overlap"), "V24", "smallest_overlap"),
            ]
        )

    def _read_back(self, results: Mapping[str, DataFrame]) -> DataFrame:
        """V21 and V26 from the result tables themselves; NULL where no table has a row."""
        checked = declared.results_checked(results, self.books_recorded(), self.p)
        bare = sum(
            1
            for name, result in declared.DECLARED.items()
            if name in results
            for column in result.figures
            if column not in results[name].columns or not results[name].schema[column].metadata.get("limits")
        )
        some = F.sum("n_rows") > 0
        sums = checked.agg(
            F.when(some, F.sum("repeated_keys")).alias("repeated"),
            F.when(some, F.sum(F.col("unlabelled_rows") + F.col("missing_books"))).alias("unlabelled"),
            F.when(some, F.lit(bare)).alias("bare"),
        )
        rows = verdict.metric_rows
        return _union(
            [
                rows(sums, "V21", {"unlabelled_figures": "unlabelled", "repeated_result_keys": "repeated"}),
                rows(sums, "V26", {"figures_without_limits": "bare"}),
            ]
        )

    def metrics(self) -> DataFrame:
        """All metrics; each group is a handful of rows once it is written."""
        return _union(
            [
                self._stage("metrics_1", self.foundation_metrics(self.foundation())),
                self._stage("metrics_2", self.build_metrics(self.build())),
                self._stage("metrics_3", self.figure_metrics(self.figures())),
            ]
        )


def _count_of(condition: Column) -> Column:
    """Rows that meet a condition; NULL when there was no row to look at, so that
    nothing passes for want of data."""
    return F.when(F.count(F.lit(1)) > 0, F.count_if(condition))


def _same(*columns: str) -> dict[str, str]:
    return {c: c for c in columns}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out
