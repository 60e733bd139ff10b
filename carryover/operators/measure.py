"""From claim lines to one outcome per confirmed member.

Unit of the measure: (book, condition, member).  Books are part of every key,
so no figure can blend them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions import mapped, normalise, share
from carryover.operators.checks import position, two_years
from carryover.operators.coverage import coverage_months
from carryover.params import Params

UNIT = ["book", "condition", "member_id"]
OFFICE = "office"
GATES = ("death", "coverage", "no_visit", "changed_doctor")


# --- claims: scope, setting, source ------------------------------------------


def curate_claims(
    claim_line: DataFrame, member_month: DataFrame, provider: DataFrame, p: Params
) -> DataFrame:
    """The curated extract: summarised, non-duplicate, non-dental lines outside
    the excluded network areas, with member and provider attributes.

    Member attributes are those of the service month.  Both attribute tables
    are reduced to one row per key first, so no claim line is repeated.  The
    provider's submarket is NULL where the provider table does not state one.

    Member months are nearly one row per key already, so they are dealt out before
    they are reduced: no scan task sorts all it reads.  Providers are dealt out again
    after it, so that the lines of a busy one can be split where neither is broadcast.
    """
    day = F.col("srv_start_dt")
    source, area = F.col("med_cost_ctg_cd"), F.col("ntwk_srv_area_id")
    kept = claim_line.where(
        (F.col("summarized_srv_ind") == "Y")
        & (F.col("duplicate_ind") == "N")
        & (source.isNull() | ~source.isin(*p.curated_sources_out))
        & (area.isNull() | ~area.isin(*p.network_areas_out))
    ).withColumns({"yr": F.year(day), "mo": F.month(day)})
    month = ["member_id", "yr", "mo"]
    member = (
        member_month.withColumns({"yr": F.col("eff_yr").cast("int"), "mo": F.col("eff_mo").cast("int")})
        .repartition(*month)
        .groupBy(*month)
        .agg(*[F.min(c).alias(c) for c in ("age_nbr", "gender_cd", "mbr_county_cd", "mbr_submarket")])
    )
    doctor = provider.groupBy(F.col(p.provider_key).alias("srv_prvdr_id")).agg(
        F.min("epdb_dw_prvdr_id").alias("epdb_dw_prvdr_id"),
        F.min("county_nm").alias("prvdr_county"),
        (F.min("prvdr_submarket") if "prvdr_submarket" in provider.columns else F.lit(None).cast("string")).alias("prvdr_submarket"),
        F.min("specialty_ctg_cd").alias("specialty_ctg_cd"),
    ).hint("rebalance")
    out = kept.join(member, month, "left")
    if p.submarkets:
        out = out.where(F.col("mbr_submarket").isin(*p.submarkets))
    return out.join(doctor, "srv_prvdr_id", "left").select(
        "claim_line_id",
        "member_id",
        "age_nbr",
        "gender_cd",
        "mbr_county_cd",
        "mbr_submarket",
        "srv_start_dt",
        "pri_icd9_dx_cd",
        "prcdr_cd",
        "allowed_amt",
        "business_ln_cd",
        "epdb_dw_prvdr_id",
        "prvdr_county",
        "prvdr_submarket",
        "specialty_ctg_cd",
    )


def scope_claims(claim_line: DataFrame, p: Params) -> DataFrame:
    """Claim lines of the configured books, each labelled with its book."""
    named = claim_line.withColumn("book", mapped(F.col("business_ln_cd"), p.books))
    return named.where(F.col("business_ln_cd").isin(*p.books))


def classify_setting(claims: DataFrame, p: Params) -> DataFrame:
    """Place of service as a setting; anything else is 'unassigned'."""
    return claims.withColumn("setting", mapped(F.col("plc_srv_cd"), p.settings, "unassigned"))


def exclude_sources(claims: DataFrame, p: Params) -> DataFrame:
    """Drop laboratory, equipment, ambulance and dental lines, as configured."""
    source = F.col("med_cost_ctg_cd")
    return claims.where(source.isNull() | ~source.isin(*p.excluded_sources))


def measured_claims(claim_line: DataFrame, p: Params) -> DataFrame:
    """Lines the measure may use: both years, in scope, an acceptable setting,
    no excluded source.  Filters on plain columns, so they reach the scan."""
    claims = exclude_sources(scope_claims(two_years(claim_line, p), p), p)
    return classify_setting(claims, p).where(F.col("plc_srv_cd").isin(*p.settings))


# --- diagnoses: expand, label, collapse ---------------------------------------


def expand_positions(claims: DataFrame, dx_line: DataFrame) -> DataFrame:
    """Claim line x diagnosis position; the one intended fan-out."""
    positions = dx_line.where(F.col("claim_line_id").isNotNull()).select(
        "claim_line_id",
        position(F.col("sequence_id")).alias("position"),
        normalise(F.col("icd9_dx_cd")).alias("code"),
    )
    return claims.join(positions, "claim_line_id")


def label_conditions(rows: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """Attach condition and category to coded rows; unlabelled rows drop out."""
    return rows.join(labels, "code")


def labelled(
    claim_line: DataFrame, dx_line: DataFrame, labels: DataFrame, p: Params
) -> DataFrame:
    """Condition records: measured claim lines x the conditions they carry.

    ``labels`` are the (condition, category, code) of the families.  Equal to
    expanding, labelling and then dropping repeats, in the order that moves
    least: diagnosis rows meet the labels in the scan stage, keep one row per
    (line, condition, category), and only those are joined to claims.  The scan
    stage it is where ``labels`` are read from files, whose size tells the
    planner that they can be broadcast; derived labels have no size before they
    run, and every diagnosis row would be shuffled by its code.
    """
    coded = dx_line.where(F.col("claim_line_id").isNotNull()).select(
        "claim_line_id", normalise(F.col("icd9_dx_cd")).alias("code")
    )
    hits = (
        label_conditions(coded, labels, p)
        .select("claim_line_id", "condition", "category")
        .distinct()
    )
    claims = measured_claims(claim_line, p).select(
        "claim_line_id",
        "book",
        "member_id",
        "srv_start_dt",
        F.year("srv_start_dt").alias("yr"),
        "srv_prvdr_id",
        "setting",
    )
    return claims.join(hits, "claim_line_id")


def member_year(records: DataFrame) -> DataFrame:
    """One row per member, year and condition: recorded anywhere, in an office."""
    return records.groupBy(*UNIT, "yr").agg(
        F.lit(True).alias("recorded_anywhere"),
        F.bool_or(F.col("setting") == OFFICE).alias("recorded_office"),
    )


def hospital_sustained(member_years: DataFrame) -> DataFrame:
    """Member-years that only hospital records keep on file."""
    only = F.count_if(F.col("recorded_anywhere") & ~F.col("recorded_office"))
    return (
        member_years.groupBy("book", "condition", "yr")
        .agg(
            F.count(F.lit(1)).alias("member_years"),
            only.alias("hospital_only"),
            share(only, F.count(F.lit(1))).alias("share_hospital_only"),
        )
        .orderBy("book", "condition", "yr")
    )


# --- outcome -------------------------------------------------------------------


def member_summary(records: DataFrame, p: Params) -> DataFrame:
    """Mentions in year one and presence in year two, per unit.

    One aggregate serves the confirmation rule, the outcome and the incidence.
    """
    y1, y2 = (F.col("yr") == y for y in p.years)
    mention = F.col("srv_start_dt")
    if p.mention_unit == "visit":
        mention = F.struct("srv_start_dt", "srv_prvdr_id")
    return records.groupBy(*UNIT).agg(
        F.countDistinct(F.when(y1, mention)).alias("mentions"),
        F.bool_or(y2).alias("carried_any"),
        F.bool_or(y2 & (F.col("setting") == OFFICE)).alias("carried_office"),
    )


def confirm_mentions(summary: DataFrame, p: Params) -> DataFrame:
    """Units with enough separate mentions in year one."""
    return summary.where(F.col("mentions") >= p.mentions).select(*UNIT, "mentions")


def two_year_outcome(summary: DataFrame, p: Params, mentions: int | None = None) -> DataFrame:
    """Confirmed units with their year-two record: carried over or missing."""
    return summary.where(F.col("mentions") >= (mentions or p.mentions)).select(
        *UNIT, "mentions", "carried_any", "carried_office"
    )


# --- gates ---------------------------------------------------------------------


def gate_death(outcome: DataFrame, member_death: DataFrame | None, p: Params) -> DataFrame:
    """``alive`` at the end of year two; NULL, not applied, without a source."""
    if member_death is None:
        return outcome.withColumn("alive", F.lit(None).cast("boolean"))
    dead = (
        member_death.groupBy("member_id")
        .agg(F.min("death_dt").alias("death_dt"))
        .where(F.col("death_dt") < F.lit(f"{p.y2 + 1}-01-01").cast("date"))
    )
    return outcome.join(dead, "member_id", "left").withColumn(
        "alive", F.col("death_dt").isNull()
    ).drop("death_dt")


def gate_coverage(outcome: DataFrame, member_month: DataFrame, p: Params) -> DataFrame:
    """``covered`` without a gap over both years."""
    return outcome.join(coverage_months(member_month, p), "member_id", "left").withColumns(
        {"months": F.coalesce("months", F.lit(0)), "covered": F.coalesce(F.col("months") == 24, F.lit(False))}
    )


def doctor_contact(claim_line: DataFrame, p: Params) -> DataFrame:
    """Lines per (member, doctor) over both years, and the years they fall in.

    ``in_y2`` is of any line; ``own_y1`` and ``own_y2`` leave out the excluded
    sources: a laboratory, an ambulance or an equipment supplier is no doctor.
    """
    year, source = F.year("srv_start_dt"), F.col("med_cost_ctg_cd")
    counts = source.isNull() | ~source.isin(*p.excluded_sources)
    return (
        two_years(claim_line, p)
        .groupBy("member_id", "srv_prvdr_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_or(year == p.y2).alias("in_y2"),
            F.bool_or((year == p.y1) & counts).alias("own_y1"),
            F.bool_or((year == p.y2) & counts).alias("own_y2"),
        )
    )


def kept_doctor() -> Column:
    """Whether a row of :func:`doctor_contact` is a named doctor of both years."""
    return F.col("own_y1") & F.col("own_y2") & F.col("srv_prvdr_id").isNotNull()


def member_contact(claim_line: DataFrame, p: Params) -> DataFrame:
    """Per member, over all claim lines of both years: lines, whether seen in
    year two, and whether one clinician saw them in both.

    Lines are counted per (member, doctor) before they are brought to the
    member, so neither a busy doctor nor a busy member is one task's work, and
    no doctor pair is formed.
    """
    return doctor_contact(claim_line, p).groupBy("member_id").agg(
        F.sum("n").alias("lines"), F.bool_or("in_y2").alias("seen"), F.bool_or(kept_doctor()).alias("same_doctor")
    )


def gate_contact(outcome: DataFrame, claim_line: DataFrame, p: Params) -> DataFrame:
    """``seen`` in year two and ``same_doctor`` in both years."""
    no = F.lit(False)
    return outcome.join(member_contact(claim_line, p), "member_id", "left").withColumns(
        {
            "lines": F.coalesce("lines", F.lit(0)),
            "seen": F.coalesce("seen", no),
            "same_doctor": F.coalesce("same_doctor", no),
        }
    )


def first_gate() -> Column:
    """The first gate a unit fails, NULL when it can be judged.

    'No visit' comes before 'changed doctor': a member nobody saw has not
    changed doctors.
    """
    passed = {"death": "alive", "coverage": "covered", "no_visit": "seen", "changed_doctor": "same_doctor"}
    out = F.lit(None).cast("string")
    for gate in reversed(GATES):
        out = F.when(~F.col(passed[gate]), F.lit(gate)).otherwise(out)
    return out


def gated(
    outcome: DataFrame,
    claim_line: DataFrame,
    member_month: DataFrame,
    member_death: DataFrame | None,
    p: Params,
) -> DataFrame:
    """Outcome with every gate and the first one failed.  Each gate table has
    one row per member, so these joins keep the row count."""
    out = gate_death(outcome, member_death, p)
    out = gate_coverage(out, member_month, p)
    out = gate_contact(out, claim_line, p)
    return out.withColumn("gate", first_gate()).withColumn("judged", F.col("gate").isNull())


def attrition(gates: DataFrame) -> DataFrame:
    """Units removed by each gate in order, and what is left after it.

    One aggregate turned into rows; units are charged to their first gate.
    """
    removed = [F.count_if(F.coalesce(F.col("gate") == g, F.lit(False))).alias(f"r{i}") for i, g in enumerate(GATES)]
    counts = gates.groupBy("book", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("alive").isNotNull()).alias("death_known"), *removed
    )
    rows, left = ["0, 'confirmed', true, 0L, n"], "n"
    for i, gate in enumerate(GATES):
        left += f" - r{i}"
        applied = "death_known" if gate == "death" else "true"
        rows.append(f"{i + 1}, '{gate}', {applied}, r{i}, {left}")
    return (
        counts.select(
            "book",
            "condition",
            "n",
            F.expr(f"stack({len(rows)}, {', '.join(rows)}) AS (gate_order, gate, applied, removed, remaining)"),
        )
        .select(
            "book",
            "condition",
            "gate_order",
            "gate",
            "applied",
            "removed",
            "remaining",
            share(F.col("removed"), F.col("n")).alias("share_removed"),
        )
        .orderBy("book", "condition", "gate_order")
    )


def code_moves(records: DataFrame, outcome: DataFrame, p: Params) -> DataFrame:
    """What measuring at family level keeps: units carried over in the family
    but in none of the categories they had before."""
    y1, y2 = (F.col("yr") == y for y in p.years)
    per_category = records.groupBy(*UNIT, "category").agg(
        F.bool_or(y1).alias("before"), F.bool_or(y2).alias("after")
    )
    kept = per_category.groupBy(*UNIT).agg(F.bool_or(F.col("before") & F.col("after")).alias("same_category"))
    n, same = F.count(F.lit(1)), F.count_if("same_category")
    family = F.count_if("carried_any")
    return (
        outcome.join(kept, UNIT)
        .groupBy("book", "condition")
        .agg(
            n.alias("confirmed"),
            family.alias("carried_family"),
            same.alias("carried_same_category"),
            (family - same).alias("moved_within_family"),
            share(family - same, n).alias("share_moved"),
        )
        .orderBy("book", "condition")
    )


def condition_incidence(
    summary: DataFrame, claim_line: DataFrame, member_month: DataFrame, p: Params
) -> DataFrame:
    """Conditions newly recorded in year two among members covered throughout.

    At risk: fully covered, with a claim under the book in either year, and no
    record of the condition in year one.
    """
    covered = coverage_months(member_month, p).where(F.col("months") == 24).select("member_id")
    base = (
        scope_claims(two_years(claim_line, p), p)
        .select("book", "member_id")
        .distinct()
        .join(covered, "member_id", "left_semi")
        .select(
            "book",
            "member_id",
            F.explode(F.array(*[F.lit(f) for f in p.families])).alias("condition"),
        )
    )
    new = F.count_if("carried_any")
    return (
        base.join(summary.select(*UNIT, "mentions", "carried_any"), UNIT, "left")
        .where(F.coalesce("mentions", F.lit(0)) == 0)
        .groupBy("book", "condition")
        .agg(
            F.count(F.lit(1)).alias("at_risk"),
            new.alias("newly_recorded"),
            share(new, F.count(F.lit(1))).alias("incidence"),
        )
        .orderBy("book", "condition")
    )


def member_burden(
    claim_line: DataFrame, dx_line: DataFrame, categories: DataFrame, p: Params
) -> DataFrame:
    """Distinct categories per (book, member) in year one: the illness burden.

    ``categories`` are the distinct (code, category) of the code map.
    """
    coded = dx_line.where(F.col("claim_line_id").isNotNull()).select(
        "claim_line_id", normalise(F.col("icd9_dx_cd")).alias("code")
    )
    hits = label_conditions(coded, categories, p).select("claim_line_id", "category").distinct()
    claims = measured_claims(claim_line, p).where(F.year("srv_start_dt") == p.y1)
    return (
        claims.select("claim_line_id", "book", "member_id")
        .join(hits, "claim_line_id")
        .select("book", "member_id", "category")
        .distinct()
        .groupBy("book", "member_id")
        .agg(F.count(F.lit(1)).alias("burden"))
    )


def member_age(member_month: DataFrame, p: Params) -> DataFrame:
    """Age per member in year one."""
    return (
        member_month.where(F.col("eff_yr").cast("int") == p.y1)
        .groupBy("member_id")
        .agg(F.max("age_nbr").alias("age"))
    )
