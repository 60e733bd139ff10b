"""From judged members to doctor scores.

A doctor's panel is made of the doctor's own patients: confirmed members with
at least one year-one office record by that doctor.  A member may be in several
panels.  Scores are kept as counts and compared as whole ten-thousandths, so
ranks do not depend on how sums were ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions import byar, histogram_rank, integer_rate, normalise, share, wilson
from carryover.operators.checks import position, two_years
from carryover.operators.measure import OFFICE, UNIT, classify_setting, doctor_contact, kept_doctor
from carryover.params import Params

PEERS = ["book", "condition", "specialty"]
DOCTOR = ["book", "condition", "provider_id"]
SCORE_SCALE = 10_000
RATE_SCALE = 1_000_000


def member_doctor(records: DataFrame, p: Params) -> DataFrame:
    """(unit, provider) pairs of the panels: office record in year one, and
    whether the same doctor has one in year two."""
    in_office = F.col("setting") == OFFICE
    return (
        records.where(in_office & F.col("srv_prvdr_id").isNotNull())
        .groupBy(*UNIT, F.col("srv_prvdr_id").alias("provider_id"))
        .agg(
            F.bool_or(F.col("yr") == p.y1).alias("in_panel"),
            F.bool_or(F.col("yr") == p.y2).alias("carried_same"),
        )
        .where("in_panel")
        .drop("in_panel")
    )


def panels(gates: DataFrame, records: DataFrame, claim_line: DataFrame, p: Params) -> DataFrame:
    """Panel rows: a doctor's confirmed members with their outcome and gates.

    A doctor answers for a member only while the member stays with that doctor:
    ``judged`` is narrowed from "some doctor saw the member in both years" to
    "this doctor did".  The gates of the member are left as they are.
    """
    stayed = (
        doctor_contact(claim_line, p)
        .where(kept_doctor())
        .select("member_id", F.col("srv_prvdr_id").alias("provider_id"), F.lit(True).alias("stayed"))
    )
    rows = gates.join(member_doctor(records, p), UNIT).join(stayed, ["member_id", "provider_id"], "left")
    return rows.withColumn("judged", F.col("judged") & F.coalesce("stayed", F.lit(False))).drop("stayed")


def specialties(provider: DataFrame, p: Params) -> DataFrame:
    """One specialty per provider key; a doctor without one is its own group."""
    return provider.groupBy(F.col(p.provider_key).alias("provider_id")).agg(
        F.min("specialty_ctg_cd").alias("specialty")
    )


def _with_specialty(doctors: DataFrame, provider: DataFrame, p: Params) -> DataFrame:
    return doctors.join(specialties(provider, p), "provider_id", "left").withColumn(
        "specialty", F.coalesce("specialty", F.lit("(none)"))
    )


def provider_scores(panel: DataFrame, provider: DataFrame, p: Params) -> DataFrame:
    """Panel size and persistence per doctor: by any record, by an office record
    of any doctor, and by an office record of the same doctor."""
    judged = F.col("judged")
    per_doctor = panel.groupBy(*DOCTOR).agg(
        F.count(F.lit(1)).alias("panel_confirmed"),
        F.count_if(judged).alias("panel"),
        F.count_if(judged & F.col("carried_any")).alias("carried_any"),
        F.count_if(judged & F.col("carried_office")).alias("carried_office"),
        F.count_if(judged & F.col("carried_same")).alias("carried_same"),
    )
    return _with_specialty(per_doctor, provider, p).select(
        *DOCTOR,
        "specialty",
        "panel_confirmed",
        "panel",
        "carried_any",
        "carried_office",
        "carried_same",
        share(F.col("carried_any"), F.col("panel")).alias("score_any"),
        share(F.col("carried_office"), F.col("panel")).alias("score_office"),
        share(F.col("carried_same"), F.col("panel")).alias("score_same"),
    )


def is_scored(p: Params, min_panel: Column | int | None = None) -> Column:
    basis = F.col("panel_confirmed" if p.panel_basis == "confirmed" else "panel")
    return (basis >= (p.min_panel if min_panel is None else min_panel)) & (F.col("panel") > 0)


def min_panel(scores: DataFrame, p: Params) -> DataFrame:
    """Mark doctors with too few patients; their scores are withheld."""
    scored = is_scored(p)
    out = scores.withColumn(
        "status", F.when(scored, F.lit("scored")).otherwise(F.lit("not enough to tell"))
    )
    held = {c: F.when(scored, F.col(c)) for c in ("score_any", "score_office", "score_same")}
    return out.withColumns(held)


def shrunk_score(n: Column, d: Column, peer_n: Column, peer_d: Column, weight: int) -> Column:
    """(n + weight * peer rate) / (d + weight) in whole ten-thousandths."""
    return integer_rate(
        n * peer_d + F.lit(weight) * peer_n, peer_d * (d + F.lit(weight)), SCORE_SCALE
    )


def shrink_scores(scores: DataFrame, p: Params) -> DataFrame:
    """Scores pulled toward the mean of the specialty, the more so the smaller
    the panel.  Peer sums are one row per specialty, joined back."""
    peer = scores.groupBy(*PEERS).agg(
        F.sum("carried_same").alias("peer_carried"), F.sum("panel").alias("peer_panel")
    )
    return (
        scores.where(is_scored(p))
        .join(peer, PEERS)
        .select(
            *DOCTOR,
            "specialty",
            "panel_confirmed",
            "panel",
            "carried_same",
            "peer_carried",
            "peer_panel",
            share(F.col("carried_same"), F.col("panel")).alias("score_same"),
            share(F.col("peer_carried"), F.col("peer_panel")).alias("peer_rate"),
            shrunk_score(
                F.col("carried_same"),
                F.col("panel"),
                F.col("peer_carried"),
                F.col("peer_panel"),
                p.shrink_weight,
            ).alias("shrunk_units"),
        )
        .withColumn("shrunk_score", F.col("shrunk_units") / F.lit(float(SCORE_SCALE)))
    )


# --- comparing like with like ---------------------------------------------------


def standardised(
    panel: DataFrame, provider: DataFrame, age: DataFrame, burden: DataFrame, p: Params
) -> DataFrame:
    """Observed and expected persistence per doctor and mention rule, by indirect
    standardisation.

    Every stratum (specialty, ten-year age band, number of categories up to
    five) has one rate; a doctor's expectation is the sum of the rates of the
    doctor's members.  Rates are whole millionths, so the sum is exact.
    ``panel`` holds every unit with at least the smallest number of mentions; one
    pass counts it under every rule, and a rule with k mentions has the columns
    confirmed_k, panel_k, carried_k and units_k (expected millionths).
    """
    rules = sorted({p.mentions, *p.sensitivity_mentions})
    judged = F.col("judged")

    def per_rule(make) -> list[Column]:
        return [c.alias(f"{name}_{k}") for k in rules for name, c in make(k).items()]

    def counted(k: int) -> dict[str, Column]:
        enough = F.col("mentions") >= k
        return {
            "confirmed": F.count_if(enough),
            "panel": F.count_if(enough & judged),
            "carried": F.count_if(enough & judged & F.col("carried_same")),
        }

    cells = (
        panel.join(age, "member_id", "left")
        .join(burden, ["book", "member_id"], "left")
        .groupBy(
            *DOCTOR,
            F.coalesce(F.call_function("div", F.col("age"), F.lit(10)), F.lit(-1)).alias("age_band"),
            F.least(F.coalesce("burden", F.lit(0)), F.lit(5)).alias("burden_band"),
        )
        .agg(*per_rule(counted))
    )
    cells = _with_specialty(cells, provider, p)
    stratum = [*PEERS, "age_band", "burden_band"]
    rates = cells.groupBy(*stratum).agg(
        *per_rule(lambda k: {"rate": integer_rate(F.sum(f"carried_{k}"), F.sum(f"panel_{k}"), RATE_SCALE)})
    )

    def summed(k: int) -> dict[str, Column]:
        own = {c: F.sum(f"{c}_{k}") for c in ("confirmed", "panel", "carried")}
        return own | {"units": F.coalesce(F.sum(F.col(f"panel_{k}") * F.col(f"rate_{k}")), F.lit(0))}

    return cells.join(rates, stratum).groupBy(*DOCTOR, "specialty").agg(*per_rule(summed))


def under_rule(doctors: DataFrame, mentions: int) -> DataFrame:
    """The doctors of :func:`standardised` under one mention rule."""
    names = {"confirmed": "panel_confirmed", "panel": "panel", "carried": "carried_same", "units": "units"}
    return doctors.select(
        *DOCTOR, "specialty", *[F.col(f"{c}_{mentions}").alias(name) for c, name in names.items()]
    ).where("panel_confirmed > 0")


def peer_compare(doctors: DataFrame) -> DataFrame:
    """Observed against expected persistence with the 95 % interval of their ratio."""
    units, seen = F.col("units"), F.col("carried_same")
    return (
        doctors.where("panel > 0")
        .select(
            *DOCTOR,
            "specialty",
            "panel",
            seen.alias("observed"),
            share(units, F.lit(RATE_SCALE), 2).alias("expected"),
            share(seen * F.lit(RATE_SCALE), units).alias("observed_to_expected"),
            byar(seen, units, RATE_SCALE, "low").alias("ratio_low"),
            byar(seen, units, RATE_SCALE, "high").alias("ratio_high"),
        )
        .orderBy(*DOCTOR)
    )


def shrunk_ratio(observed: Column, units: Column, peer_n: Column, peer_d: Column, weight: int) -> Column:
    """Observed over expected in whole ten-thousandths, both raised by ``weight``
    patients of the specialty who fare as expected."""
    more = F.lit(weight) * integer_rate(peer_n, peer_d, RATE_SCALE)
    return integer_rate(observed * F.lit(RATE_SCALE) + more, units + more, SCORE_SCALE)


def rank_scores(doctors: DataFrame, p: Params) -> DataFrame:
    """Rank scoreable doctors in their peer group and flag the bottom share of each.

    The rank follows the ratio of observed to expected, so that a doctor is
    compared with what peers reach on patients of the same age and illness
    burden; the ratio is pulled toward one, the more so the smaller the panel.
    """
    peer = doctors.groupBy(*PEERS).agg(F.sum("carried_same").alias("peer_carried"), F.sum("panel").alias("peer_panel"))
    ratio = shrunk_ratio(
        F.col("carried_same"), F.col("units"), F.col("peer_carried"), F.col("peer_panel"), p.shrink_weight
    )
    scored = (
        doctors.where(is_scored(p))
        .join(peer, PEERS)
        .withColumn("ratio_units", ratio)
        .withColumn("score_same", share(F.col("carried_same"), F.col("panel")))
        .withColumn("adjusted_ratio", F.col("ratio_units") / F.lit(float(SCORE_SCALE)))
    )
    size = scored.groupBy(*PEERS).agg(F.count(F.lit(1)).alias("peers"))
    ranked = histogram_rank(scored, PEERS, "ratio_units", "rank").join(size, PEERS)
    return ranked.withColumn(
        "flagged", F.coalesce(F.col("rank") <= F.col("peers") * F.lit(float(p.bottom_share)), F.lit(False))
    )


def ranking(ranked: DataFrame) -> DataFrame:
    """The ranked list as reported."""
    return ranked.select(
        *DOCTOR,
        "specialty",
        "panel",
        "score_same",
        share(F.col("units"), F.lit(RATE_SCALE), 2).alias("expected"),
        "adjusted_ratio",
        "rank",
        "peers",
        "flagged",
    ).orderBy("book", "condition", "specialty", "rank", "provider_id")


# --- reading cases -----------------------------------------------------------


def _ends(ranked: DataFrame, p: Params, ends: tuple[str, ...]) -> DataFrame:
    """The ``extreme_doctors`` doctors at each end of the main condition, in each book.

    The books are a parameter, so there is one bounded top-k for each.
    """
    main = ranked.where(F.col("condition") == p.main_family)
    out = None
    for end in ends:
        for book in sorted(p.books.values()):
            order = F.asc("ratio_units") if end == "lowest" else F.desc("ratio_units")
            one = (
                main.where(F.col("book") == book)
                .orderBy(order, "provider_id")
                .limit(p.extreme_doctors)
                .select(*DOCTOR, F.lit(end).alias("doctor_end"), "adjusted_ratio")
            )
            out = one if out is None else out.unionByName(one)
    return out


def picked_visits(
    panel: DataFrame,
    ranked: DataFrame,
    claim_line: DataFrame,
    p: Params,
    *,
    ends: tuple[str, ...],
    members: int,
) -> DataFrame:
    """Every claim line of a few members of the doctors at the ends.

    The picks are bounded by ``members`` per end and are the only broadcast.
    """
    chosen = panel.where("judged").join(F.broadcast(_ends(ranked, p, ends)), DOCTOR)
    picks = None
    for end in ends:
        one = (
            chosen.where(F.col("doctor_end") == end)
            .orderBy(F.md5(F.col("member_id").cast("string").cast("binary")), "member_id", "provider_id")
            .limit(members)
            .select(
                "doctor_end",
                "book",
                F.col("provider_id").alias("scored_provider_id"),
                "adjusted_ratio",
                "member_id",
                "carried_same",
            )
        )
        picks = one if picks is None else picks.unionByName(one)
    visits = classify_setting(two_years(claim_line, p), p).select(
        "claim_line_id", "member_id", "srv_start_dt", "srv_prvdr_id", "setting"
    )
    return visits.join(F.broadcast(picks), "member_id")


def histories(visits: DataFrame, dx_line: DataFrame, codes: DataFrame) -> DataFrame:
    """The visits with every position of theirs, in order of date, for reading;
    positions with one of ``codes`` are marked.

    Diagnosis rows meet the few picked lines where they are scanned.  Nothing is
    gathered into lists, so a member with any number of visits stays spread out.
    """
    lines = visits.where(F.col("claim_line_id").isNotNull()).select("claim_line_id").distinct()
    coded = dx_line.where(F.col("claim_line_id").isNotNull()).select(
        "claim_line_id",
        position(F.col("sequence_id")).alias("position"),
        normalise(F.col("icd9_dx_cd")).alias("code"),
    )
    theirs = coded.join(lines, "claim_line_id", "left_semi")
    family = codes.withColumn("in_family", F.lit(True))
    return (
        visits.join(theirs, "claim_line_id", "left")
        .join(family, "code", "left")
        .select(
            "doctor_end",
            "book",
            "scored_provider_id",
            "adjusted_ratio",
            "member_id",
            "carried_same",
            "srv_start_dt",
            "claim_line_id",
            "srv_prvdr_id",
            "setting",
            "position",
            "code",
            F.coalesce("in_family", F.lit(False)).alias("in_family"),
        )
        .orderBy("doctor_end", "scored_provider_id", "member_id", "srv_start_dt", "claim_line_id", "position", "code")
    )


def flag_survival(ranked: DataFrame, p: Params) -> DataFrame:
    """Flagged doctors with what a challenge would ask for.

    A flag survives when enough patients were judged, the 95 % interval of the
    doctor's own rate lies below the peer rate, and that of observed over
    expected below one: neither chance nor the patients explain it.
    """
    n, d, units = F.col("carried_same"), F.col("panel"), F.col("units")
    low, high = (wilson(n, d, s) for s in ("low", "high"))
    ratio_low, ratio_high = (byar(n, units, RATE_SCALE, s) for s in ("low", "high"))
    peer_rate = share(F.col("peer_carried"), F.col("peer_panel"))
    enough = d >= p.min_panel
    return (
        ranked.where("flagged")
        .select(
            *DOCTOR,
            "specialty",
            "panel",
            "score_same",
            low.alias("interval_low"),
            high.alias("interval_high"),
            peer_rate.alias("peer_rate"),
            "adjusted_ratio",
            ratio_low.alias("ratio_low"),
            ratio_high.alias("ratio_high"),
            enough.alias("enough_patients"),
            F.coalesce(enough & (high < peer_rate) & (ratio_high < 1.0), F.lit(False)).alias("survives"),
        )
        .orderBy(*DOCTOR)
    )


def final_list(survival: DataFrame) -> DataFrame:
    """The list that may leave the analysis: flagged doctors without those whose flag does not survive."""
    return (
        survival.where("survives")
        .select(
            *DOCTOR, "specialty", "panel", "score_same", "interval_high", "peer_rate", "adjusted_ratio", "ratio_high"
        )
        .orderBy(*DOCTOR)
    )


def unsupported(listed: DataFrame, survival: DataFrame, ranked: DataFrame) -> DataFrame:
    """How many doctors of a list have no surviving flag, and how many surviving flags
    it leaves out; NULL where no doctor was ranked at all."""
    some = ranked.agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    theirs = survival.where("survives").select(*DOCTOR, F.lit(True).alias("supported"))
    both = listed.select(*DOCTOR, F.lit(True).alias("listed")).join(theirs, DOCTOR, "full")
    counts = both.agg(
        F.count_if(F.col("supported").isNull()).alias("unsupported"),
        F.count_if(F.col("listed").isNull()).alias("left_out"),
    )
    return counts.select(*[F.when(some, F.col(c)).alias(c) for c in ("unsupported", "left_out")])
