"""Thresholds as data, verdicts as a join.

A check has one or more metrics.  Each is compared with its bounds; the check
takes the worst result and a gate the worst of the checks it needs.  Between
pass and fail a person has to judge: REVIEW.  A metric nobody could compute is
UNVERIFIABLE, never PASS.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICTS = ("PASS", "REVIEW", "UNVERIFIABLE", "FAIL")  # from best to worst


@dataclass(frozen=True)
class Bound:
    """Pass and fail sides of one metric.

    ``kind``: above / at_least (large is good; fail when below ``fail``, or at
    it for ``fail_at``), below / at_most (small is good), or band (pass between
    ``good`` and ``good_high``, fail outside ``fail`` .. ``fail_high``).
    """

    check: str
    metric: str
    kind: str
    good: float
    fail: float
    on_failure: str
    blocks: bool = False
    fail_at: bool = False
    good_high: float = 0.0
    fail_high: float = 0.0


# The bounds each check was given.  V11, V13, V14, V17 and V19 were given
# in words; their numbers, and the fail side of V6, are choices of this library.
BOUNDS = (
    Bound("EDA_0b", "max_rows_per_line", "at_most", 1, 1, "stop before the probe", True),
    Bound("EDA_0c", "match_rate", "at_least", 0.95, 0.95, "stop everything", True),
    Bound("EDA_0c", "lines_member_disagree", "at_most", 0, 0, "stop everything", True),
    Bound("EDA_1", "categories", "at_least", 1, 1, "stop", True),
    Bound("V1", "max_position", "above", 1, 1, "stop everything", True, fail_at=True),
    Bound("V2", "share_exactly_one", "at_most", 0.90, 0.90, "compare with V1"),
    Bound("V2", "avg_dx_per_claim_line", "above", 1, 1, "compare with V1"),
    Bound("V2", "share_over_ten", "above", 0, 0, "compare with V1"),
    Bound("V3", "agreement", "above", 0.95, 0.80, "read the disagreeing pairs", True),
    Bound("V4", "within_10pct", "at_least", 1, 1, "move the window back a year"),
    Bound("V5", "share_full_present", "at_least", 0.95, 0.85, "build a crosswalk"),
    Bound("V6", "match_rate", "above", 0.95, 0.90, "stop", True),
    Bound("V6", "member_mismatch", "at_most", 0, 0, "stop", True),
    Bound("V6", "multi_member_lines", "at_most", 0, 0, "stop", True),
    Bound("V7", "diff_pct_points", "at_least", 1.0, 0, "stop and report", True, fail_at=True),
    Bound("V8", "match_rate_by_code", "above", 0.95, 0.90, "compare the code shapes"),
    Bound("V9", "stages_not_accounted_for", "at_most", 0, 0, "fix and rebuild", True),
    Bound("V10", "repeated_keys", "at_most", 0, 0, "fix and rebuild", True),
    Bound("V10", "lost_or_invented_keys", "at_most", 0, 0, "fix and rebuild", True),
    Bound("V11", "share_unassigned", "at_most", 0, 0, "read the unassigned places of service"),
    Bound("V11", "office_lead", "above", 1, 1, "read the settings by specialty"),
    Bound("V11", "share_disagree", "at_most", 0.05, 0.20, "read the settings by specialty"),
    Bound("V12", "excluded_lines", "at_most", 0, 0, "fix and rebuild", True),
    Bound("V13", "codes_changed", "at_most", 0, 0, "map old codes to new before comparing"),
    Bound("V14", "difference", "at_least", 0.05, 0.0, "reconsider the mention rule", fail_at=True),
    Bound("V14", "z", "above", 1.96, 0.0, "reconsider the mention rule", fail_at=True),
    Bound("V15", "largest_share_removed", "at_most", 1 / 3, 1.0, "explain the gate", True),
    Bound("V16", "persistence", "band", 0.65, 0.50, "investigate", True, good_high=0.85, fail_high=0.95),
    Bound("V17", "end_share", "at_most", 0.10, 0.25, "look for small panels and data faults"),
    Bound("V17", "dip_share", "at_most", 0.25, 0.50, "look for two populations"),
    Bound("V19", "control_minus_main", "at_most", 0.05, 0.15, "weaken the claim"),
    Bound("V19", "difference_high", "at_most", 0.10, 0.30, "weaken the claim"),
    Bound("V20", "office_above_any", "at_most", 0, 0, "the build is wrong", True),
    Bound("V21", "unlabelled_figures", "at_most", 0, 0, "label every figure"),
    Bound("V21", "repeated_result_keys", "at_most", 0, 0, "label every figure"),
    Bound("V22", "unsupported", "at_most", 0, 0, "remove them from the list", True),
    Bound("V22", "left_out", "at_most", 0, 0, "remove them from the list", True),
    Bound("V23", "largest_difference", "at_most", 0.1, 0.25, "adjust or claim less", True),
    Bound("V24", "smallest_overlap", "at_least", 0.8, 0.5, "report consistent doctors only", True),
    Bound("V26", "figures_without_limits", "at_most", 0, 0, "attach them", True),
)

FOUNDATION_CHECKS = tuple(b.check for b in BOUNDS if b.check.startswith("EDA")) + tuple(
    f"V{i}" for i in range(1, 9)
)

# Checks a person does; a result is passed in, otherwise UNVERIFIABLE.
READ_BY_PERSON = {"V18": "stop and find out why", "V25": "rewrite before circulation"}

# What each gate needs.
GATE_CHECKS = {
    "1 foundation": ("V1", "V3", "V6", "V7"),
    "2 build": ("V9", "V10", "V12", "V15"),
    "3 plausibility": ("V16", "V18", "V20"),
    "4 fairness": ("V22", "V23", "V24", "V25", "V26"),
}


def metric_rows(df: DataFrame, check: str, columns: Mapping[str, Column | str]) -> DataFrame:
    """(check, metric, value) rows from the columns of a one-row result."""
    values = df.select(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(m) for m, c in columns.items()])
    lines = ", ".join(f"'{check}', '{m}', `{m}`" for m in columns)
    return values.select(F.expr(f"stack({len(columns)}, {lines}) AS (check, metric, value)"))


def _bounds(spark: SparkSession, checks: Collection[str] | None) -> DataFrame:
    """The bound table as inline rows."""
    bounds = [b for b in BOUNDS if checks is None or b.check in checks]
    rows = ", ".join(
        f"('{b.check}', '{b.metric}', '{b.kind}', {float(b.good)!r}D, {float(b.fail)!r}D, {float(b.good_high)!r}D,"
        f" {float(b.fail_high)!r}D, {str(b.fail_at).lower()}, {str(b.blocks).lower()}, '{b.on_failure}')"
        for b in bounds
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows}"
        " AS t(check, metric, kind, good, fail, good_high, fail_high, fail_at, blocks, on_failure)"
    )


def _verdict() -> Column:
    v, good, fail, at = F.col("value"), F.col("good"), F.col("fail"), F.col("fail_at")
    failed = (
        F.when(F.col("kind").isin("above", "at_least"), (v < fail) | (at & (v == fail)))
        .when(F.col("kind").isin("below", "at_most"), v > fail)
        .otherwise((v < fail) | (v > F.col("fail_high")))
    )
    passed = (
        F.when(F.col("kind") == "above", v > good)
        .when(F.col("kind") == "at_least", v >= good)
        .when(F.col("kind") == "below", v < good)
        .when(F.col("kind") == "at_most", v <= good)
        .otherwise(v.between(good, F.col("good_high")))
    )
    return (
        F.when(v.isNull(), "UNVERIFIABLE").when(failed, "FAIL").when(passed, "PASS").otherwise("REVIEW")
    )


def metric_verdicts(metrics: DataFrame, checks: Collection[str] | None = None) -> DataFrame:
    """Every bound (of ``checks``) with its value and verdict; a missing metric
    keeps its row."""
    bounds = _bounds(metrics.sparkSession, checks)
    return (
        F.broadcast(bounds)
        .join(metrics, ["check", "metric"], "left")
        .select("check", "metric", "value", _verdict().alias("verdict"), "blocks", "on_failure")
        .orderBy("check", "metric")
    )


def _level(verdict: str = "verdict") -> Column:
    out = F.lit(0)
    for i, name in enumerate(VERDICTS):
        out = F.when(F.col(verdict) == name, F.lit(i)).otherwise(out)
    return out


def _name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), level + 1)


def check_verdicts(metrics: DataFrame, read: Mapping[str, str] | None = None) -> DataFrame:
    """One row per check, with the worst verdict of its metrics."""
    verdicts = metric_verdicts(metrics).select("check", "verdict", "blocks", "on_failure")
    people = ", ".join(
        f"('{c}', '{(read or {}).get(c, 'UNVERIFIABLE')}', true, '{action}')" for c, action in READ_BY_PERSON.items()
    )
    by_hand = metrics.sparkSession.sql(f"SELECT * FROM VALUES {people} AS t(check, verdict, blocks, on_failure)")
    return (
        verdicts.unionByName(by_hand)
        .groupBy("check")
        .agg(
            _name(F.max(_level())).alias("verdict"),
            F.bool_or("blocks").alias("blocks"),
            F.min("on_failure").alias("on_failure"),
        )
        .orderBy("check")
    )


def gate_signoff(metrics: DataFrame, read: Mapping[str, str] | None = None) -> DataFrame:
    """Per gate: the checks it needs, how they came out, and the sign-off.

    A gate is signed off when nothing it needs failed, is open or must be
    reviewed, and every gate before it was.
    """
    pairs = ", ".join(f"('{g}', '{c}')" for g, checks in GATE_CHECKS.items() for c in checks)
    needs = metrics.sparkSession.sql(f"SELECT * FROM VALUES {pairs} AS t(gate, check)")
    checks = needs.join(F.broadcast(check_verdicts(metrics, read).select("check", "verdict")), "check", "left")
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS]
    per_gate = checks.groupBy("gate").agg(
        F.count(F.lit(1)).alias("checks"),
        *counts,
        _name(F.max(_level())).alias("verdict"),
        F.bool_and(F.col("verdict") == "PASS").alias("all_pass"),
    )
    # gates are few: an earlier one that is open keeps the later ones shut
    earlier = per_gate.select(F.col("gate").alias("before"), F.col("all_pass").alias("open_before"))
    return (
        per_gate.join(F.broadcast(earlier), F.col("before") <= F.col("gate"))
        .groupBy("gate", "checks", *[v.lower() for v in VERDICTS], "verdict")
        .agg(F.bool_and("open_before").alias("signed_off"))
        .orderBy("gate")
    )
