"""Gates 2 to 4: was it built as intended, is it plausible, is it fair?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carryover.functions import histogram_rank, normalise, share, signed_share
from carryover.functions.columns import Z95
from carryover.operators.checks import two_years
from carryover.operators.codes import NOT_LISTED, status_on
from carryover.operators.doctors import DOCTOR, PEERS, is_scored, shrunk_ratio, specialties
from carryover.operators.measure import UNIT, classify_setting, exclude_sources, measured_claims, scope_claims
from carryover.params import Params


def _rows() -> Column:
    return F.count(F.lit(1))


# --- Gate 2: build -------------------------------------------------------------


def stage_reconcile(
    claim_line: DataFrame, dx_line: DataFrame, records: DataFrame, gates: DataFrame, p: Params
) -> DataFrame:
    """Rows and members of every stage beside the stage before.

    The fan-out is counted from diagnosis counts per line; it is not formed.
    Every stage is one count per (book, member) before members are counted.
    """
    claims = scope_claims(two_years(claim_line, p), p)
    per_line = dx_line.where(F.col("claim_line_id").isNotNull()).groupBy("claim_line_id").agg(_rows().alias("n"))
    main = records.where(F.col("condition") == p.main_family)
    judged = gates.where(F.col("condition") == p.main_family)
    one = F.lit(1).cast("long").alias("n")
    member_years = main.select("book", "member_id", "yr").distinct()
    stages = [
        ("claim lines", False, claims.select("book", "member_id", one)),
        (
            "line x position",
            True,
            claims.select("claim_line_id", "book", "member_id").join(per_line, "claim_line_id").select("book", "member_id", "n"),
        ),
        ("condition records", False, main.select("book", "member_id", one)),
        ("member x year", False, member_years.select("book", "member_id", one)),
        ("confirmed members", False, judged.select("book", "member_id", one)),
        ("judgeable members", False, judged.where("judged").select("book", "member_id", one)),
    ]
    rows = None
    for i, (name, fans_out, df) in enumerate(stages):
        stage = df.groupBy("book", "member_id").agg(F.sum("n").alias("n")).select(
            "book", F.lit(i + 1).alias("stage_order"), F.lit(name).alias("stage"),
            F.lit(fans_out).alias("fan_out_intended"), "member_id", "n",
        )
        rows = stage if rows is None else rows.unionByName(stage)
    counts = rows.groupBy("book", "stage_order", "stage", "fan_out_intended").agg(
        F.sum("n").alias("n_rows"), F.count("member_id").alias("members")
    )
    # one row per stage and book
    before = Window.partitionBy("book").orderBy("stage_order")
    grew = (F.col("n_rows") > F.lag("n_rows").over(before)) & ~F.col("fan_out_intended")
    new = F.col("members") > F.lag("members").over(before)
    return counts.withColumn("accounted_for", ~F.coalesce(grew | new, F.lit(False))).orderBy("book", "stage_order")


def collapse_unique(member_years: DataFrame, records: DataFrame) -> DataFrame:
    """The collapsed rows held against the keys of the records they came from: keys
    that repeat, and keys lost or invented on the way; zeros are right.

    Both sides are counted per key and put under each other, so nothing is joined.
    """
    key = [*UNIT, "yr"]
    kept = member_years.groupBy(*key).agg(_rows().alias("kept"), F.lit(0).cast("long").alias("seen"))
    seen = records.groupBy(*key).agg(F.lit(0).cast("long").alias("kept"), F.lit(1).cast("long").alias("seen"))
    per_key = kept.unionByName(seen).groupBy(*key).agg(F.sum("kept").alias("kept"), F.sum("seen").alias("seen"))
    return per_key.agg(
        F.coalesce(F.sum("kept"), F.lit(0)).alias("member_years"),
        F.count_if(F.col("kept") > 1).alias("repeated_keys"),
        F.count_if((F.col("kept") > 0) != (F.col("seen") > 0)).alias("lost_or_invented_keys"),
    )


def setting_agreement(claim_line: DataFrame, provider: DataFrame, p: Params) -> DataFrame:
    """Settings crossed with provider specialty, counted per provider first."""
    claims = classify_setting(exclude_sources(scope_claims(two_years(claim_line, p), p), p), p)
    per_doctor = claims.groupBy("book", "setting", F.col("srv_prvdr_id").alias("provider_id")).agg(_rows().alias("n"))
    cells = (
        per_doctor.join(specialties(provider, p), "provider_id", "left")
        .groupBy("book", "setting", F.coalesce("specialty", F.lit("(none)")).alias("specialty"))
        .agg(F.sum("n").alias("n_rows"))
    )
    per_specialty = cells.groupBy("book", "specialty").agg(F.sum("n_rows").alias("in_specialty"))
    per_book = cells.groupBy("book").agg(F.sum("n_rows").alias("in_book"))
    return (
        cells.join(per_specialty, ["book", "specialty"])
        .join(per_book, "book")
        .select(
            "book",
            "setting",
            "specialty",
            "n_rows",
            share(F.col("n_rows"), F.col("in_specialty")).alias("share_of_specialty"),
            share(F.col("n_rows"), F.col("in_book")).alias("share_of_rows"),
        )
        .orderBy("book", "setting", "specialty")
    )


def setting_summary(cells: DataFrame, p: Params) -> DataFrame:
    """What V11 is judged on, per book, from the cells of :func:`setting_agreement`.

    ``office_lead`` is office lines over those of the next largest setting;
    ``share_disagree`` counts lines outside the settings their specialty is
    expected in, among specialties with such a list (NULL without any).
    """
    n, setting = F.col("n_rows"), F.col("setting")
    per_setting = cells.groupBy("book", "setting").agg(F.sum("n_rows").alias("n_rows"))
    sizes = per_setting.groupBy("book").agg(
        F.sum(n).alias("lines"),
        F.sum(F.when(setting == "office", n).otherwise(0)).alias("office"),
        F.max(F.when(setting != "office", n)).alias("next_largest"),
        F.sum(F.when(setting == "unassigned", n).otherwise(0)).alias("unassigned"),
    )
    expected, known = F.lit(False), F.lit(False)
    for name, where in p.specialty_settings.items():
        own = F.col("specialty") == name
        known, expected = known | own, expected | (own & setting.isin(*where))
    judged = cells.groupBy("book").agg(
        F.sum(F.when(known, n).otherwise(0)).alias("judged_lines"),
        F.sum(F.when(known & ~expected, n).otherwise(0)).alias("disagree"),
    )
    return sizes.join(judged, "book").select(
        "book",
        "lines",
        share(F.col("unassigned"), F.col("lines")).alias("share_unassigned"),
        share(F.col("office"), F.coalesce("next_largest", F.lit(1))).alias("office_lead"),
        share(F.col("disagree"), F.col("judged_lines")).alias("share_disagree"),
    ).orderBy("book")


def excluded_absent(records: DataFrame, claim_line: DataFrame, p: Params) -> DataFrame:
    """Measured lines whose claim is an excluded source in the claims table."""
    excluded = (
        claim_line.where(F.col("med_cost_ctg_cd").isin(*p.excluded_sources))
        .where(F.col("claim_line_id").isNotNull())
        .select("claim_line_id", F.lit(True).alias("excluded"))
        .distinct()
    )
    lines = records.select("claim_line_id").distinct()
    return lines.join(excluded, "claim_line_id", "left").agg(
        _rows().alias("measured_lines"), F.count("excluded").alias("excluded_lines")
    )


def retired_codes(
    claim_line: DataFrame,
    dx_line: DataFrame,
    code_map: DataFrame,
    family: DataFrame,
    p: Params,
    versions: DataFrame | None = None,
) -> DataFrame:
    """Family codes by year of use, and whether their status changed in between.

    ``family`` are the distinct codes of the main condition.  A code seen in year
    one only may be retired, which looks like a recovery: ``versions``, the dated
    entries of the code lists, tell its status on the first day of year one and
    on the last day of year two.  Without them both are NULL, as is ``change``.
    Rows are counted per (line, code) in the scan stage before they meet claims,
    and statuses are joined to one row per code.
    """
    pattern = p.families[p.main_family]
    coded = dx_line.where(F.col("claim_line_id").isNotNull()).select(
        "claim_line_id", normalise(F.col("icd9_dx_cd")).alias("code")
    )
    used = (
        coded.join(family.withColumn("in_family", F.lit(True)), "code", "left")
        .where(F.col("in_family") | F.col("code").rlike(pattern))
        .groupBy("claim_line_id", "code")
        .agg(_rows().alias("n"))
    )
    claims = scope_claims(two_years(claim_line, p), p).select("claim_line_id", F.year("srv_start_dt").alias("yr"))
    known = (
        code_map.select(normalise(F.col("diagnosis_code")).alias("code"), F.lit(True).alias("known")).distinct()
    )
    in_year = [F.coalesce(F.sum(F.when(F.col("yr") == y, F.col("n"))), F.lit(0)) for y in p.years]
    counts = claims.join(used, "claim_line_id").groupBy("code").agg(
        in_year[0].alias("rows_year_1"), in_year[1].alias("rows_year_2")
    )
    if versions is None:
        none = F.lit(None).cast("string")
        counts = counts.withColumns({"status_before": none, "status_after": none})
    else:
        counts = status_on(counts, versions, f"{p.y1}-01-01", "status_before")
        counts = status_on(counts, versions, f"{p.y2}-12-31", "status_after")
    a, b = F.col("rows_year_1") > 0, F.col("rows_year_2") > 0
    before, after = F.col("status_before"), F.col("status_after")
    return (
        counts.join(known, "code", "left")
        .select(
            "code",
            "rows_year_1",
            "rows_year_2",
            F.coalesce("known", F.lit(False)).alias("mapped"),
            F.when(a & b, "both years").when(a, "year 1 only").otherwise("year 2 only").alias("use"),
            "status_before",
            "status_after",
            F.when(before == after, "unchanged")
            .when(after == NOT_LISTED, "retired")
            .when(before == NOT_LISTED, "new")
            .when(before != after, "moved")
            .alias("change"),
        )
        .orderBy("code")
    )


def two_mention_effect(summary: DataFrame, p: Params) -> DataFrame:
    """Who the mention rule leaves out, and whether they persist less."""
    n, carried = _rows(), F.count_if("carried_any")
    groups = (
        summary.where(F.col("mentions") > 0)
        .groupBy(
            "book",
            "condition",
            F.when(F.col("mentions") >= p.mentions, "confirmed").otherwise("too few mentions").alias("mention_group"),
        )
        .agg(
            n.alias("members"),
            carried.alias("carried_any"),
            F.count_if("carried_office").alias("carried_office"),
            share(carried, n).alias("persistence"),
        )
    )
    all_ = groups.groupBy("book", "condition").agg(F.sum("members").alias("all_members"))
    return (
        groups.join(all_, ["book", "condition"])
        .withColumn("share_of_members", share(F.col("members"), F.col("all_members")))
        .drop("all_members")
        .orderBy("book", "condition", "mention_group")
    )


def two_mention_test(effect: DataFrame) -> DataFrame:
    """Whether members with too few mentions persist less: the difference of the two
    proportions and its z value under a common rate.

    A large population makes any difference significant, so both are judged.
    """

    def of(group: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("mention_group") == group, F.col(column))), F.lit(0))

    sums = effect.groupBy("book", "condition").agg(
        of("confirmed", "members").alias("n_1"),
        of("confirmed", "carried_any").alias("c_1"),
        of("too few mentions", "members").alias("n_2"),
        of("too few mentions", "carried_any").alias("c_2"),
    )
    n1, c1, n2, c2 = (F.col(c).cast("double") for c in ("n_1", "c_1", "n_2", "c_2"))
    gap = F.try_divide(c1, n1) - F.try_divide(c2, n2)
    rate = F.try_divide(c1 + c2, n1 + n2)
    error = F.sqrt(rate * (F.lit(1.0) - rate) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return sums.select(
        "book",
        "condition",
        F.round(gap, 4).alias("difference"),
        F.round(F.try_divide(gap, error), 4).alias("z"),
    ).orderBy("book", "condition")


def gate_removal(attrition: DataFrame) -> DataFrame:
    """Attrition with a mark where one gate takes more than a third."""
    return attrition.where(F.col("gate_order") > 0).withColumn(
        "must_be_explained", F.coalesce(F.col("share_removed") > 1.0 / 3.0, F.lit(False))
    )


# --- Gate 3: plausibility ------------------------------------------------------


def _persistence(gates: DataFrame) -> DataFrame:
    judged = gates.where("judged").groupBy("book", "condition")
    any_, office = F.count_if("carried_any"), F.count_if("carried_office")
    return judged.agg(
        _rows().alias("judged"),
        any_.alias("carried_any"),
        office.alias("carried_office"),
        share(any_, _rows()).alias("persistence_any"),
        share(office, _rows()).alias("persistence_office"),
    )


def population_rate(gates: DataFrame, p: Params) -> DataFrame:
    """Persistence of the main condition against the published band.

    Fixed values: 0.65 to 0.85 published, above 0.95 or below 0.50 implausible.
    """
    rate = F.col("persistence_any")
    return (
        _persistence(gates.where(F.col("condition") == p.main_family))
        .withColumn(
            "band",
            F.when(rate > 0.95, "implausibly high")
            .when(rate < 0.50, "implausibly low")
            .when(rate.between(0.65, 0.85), "within")
            .otherwise("near"),
        )
        .orderBy("book")
    )


def score_distribution(scores: DataFrame, p: Params, bins: int = 20) -> DataFrame:
    """Histogram of scored doctors with the mass at both ends and local peaks.

    Windows run over at most ``bins`` rows per group.
    """
    n, d = F.col("carried_any"), F.col("panel")
    bucket = F.least(F.call_function("div", n * bins, d), F.lit(bins - 1)).cast("int")
    counts = (
        scores.where(is_scored(p))
        .groupBy("book", "condition", bucket.alias("bucket"))
        .agg(
            _rows().alias("doctors"),
            F.count_if(n == 0).alias("at_zero"),
            F.count_if(n == d).alias("at_hundred"),
        )
    )
    by = Window.partitionBy("book", "condition").orderBy("bucket")
    left = F.when(F.lag("bucket").over(by) == F.col("bucket") - 1, F.lag("doctors").over(by))
    right = F.when(F.lead("bucket").over(by) == F.col("bucket") + 1, F.lead("doctors").over(by))
    zero = F.lit(0)
    return counts.select(
        "book",
        "condition",
        "bucket",
        (F.col("bucket") / F.lit(float(bins))).alias("from_score"),
        "doctors",
        "at_zero",
        "at_hundred",
        (
            (F.col("doctors") > F.coalesce(left, zero)) & (F.col("doctors") >= F.coalesce(right, zero))
        ).alias("is_peak"),
    ).orderBy("book", "condition", "bucket")


def score_shape(histogram: DataFrame, bins: int = 20) -> DataFrame:
    """The shape of the scores of :func:`score_distribution`, per book and condition.

    ``end_share`` is the share of doctors at exactly 0 or 100 %.  ``dip_share`` is
    the deepest valley between two humps, as a share of the taller bin beside it
    on its lower side: 0 for a single peak, 1 for humps with nothing in between.
    Empty bins count as bins; windows run over ``bins`` rows per group.
    """
    group = ["book", "condition"]
    sizes = histogram.groupBy(*group).agg(
        F.sum("doctors").alias("doctors"), F.sum(F.col("at_zero") + F.col("at_hundred")).alias("ends")
    )
    every = sizes.select(*group, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bucket"))
    filled = every.join(histogram.select(*group, "bucket", F.col("doctors").alias("n")), [*group, "bucket"], "left")
    filled = filled.withColumn("n", F.coalesce("n", F.lit(0)))
    by = Window.partitionBy(*group).orderBy("bucket")
    left = F.max("n").over(by.rowsBetween(Window.unboundedPreceding, -1))
    right = F.max("n").over(by.rowsBetween(1, Window.unboundedFollowing))
    lower = F.least(left, right)
    dips = filled.withColumns({"lower": F.when(left.isNotNull() & right.isNotNull(), lower)}).groupBy(*group).agg(
        F.max(F.when(F.col("lower") > F.col("n"), share(F.col("lower") - F.col("n"), F.col("lower")))).alias("dip_share")
    )
    return (
        sizes.join(dips, group)
        .select(
            *group,
            "doctors",
            share(F.col("ends"), F.col("doctors")).alias("end_share"),
            F.coalesce("dip_share", F.lit(0.0)).alias("dip_share"),
        )
        .orderBy(*group)
    )


def _difference_end(n1: Column, d1: Column, n2: Column, d2: Column, side: str) -> Column:
    """One end of the 95 % interval of the difference of two proportions."""
    n1, d1, n2, d2 = (x.cast("double") for x in (n1, d1, n2, d2))
    p1, p2 = F.try_divide(n1, d1), F.try_divide(n2, d2)
    error = F.sqrt(F.try_divide(p1 * (F.lit(1.0) - p1), d1) + F.try_divide(p2 * (F.lit(1.0) - p2), d2))
    spread = F.lit(Z95) * error
    return F.round(p1 - p2 - spread if side == "low" else p1 - p2 + spread, 4)


def control_condition(gates: DataFrame, p: Params) -> DataFrame:
    """Persistence of the main condition beside one that cannot resolve, with the
    95 % interval of their difference."""

    def side(name: str, prefix: str) -> list[Column]:
        mine = F.col("judged") & (F.col("condition") == name)
        return [
            F.count_if(mine).alias(f"{prefix}_judged"),
            F.count_if(mine & F.col("carried_any")).alias(f"{prefix}_carried"),
        ]

    def wide(n: Column) -> Column:
        """Whole numbers whose products go past 64 bits."""
        return n.cast("decimal(19,0)")

    both = gates.groupBy("book").agg(*side(p.main_family, "main"), *side(p.control_family, "control"))
    a, b = F.col("main_carried"), F.col("main_judged")
    c, d = F.col("control_carried"), F.col("control_judged")
    return both.withColumns(
        {
            "main_persistence": share(a, b),
            "control_persistence": share(c, d),
            "control_minus_main": signed_share(c * wide(b) - a * wide(d), b * wide(d)),
            "difference_low": _difference_end(c, d, a, b, "low"),
            "difference_high": _difference_end(c, d, a, b, "high"),
        }
    ).orderBy("book")


def office_vs_any(scores: DataFrame) -> DataFrame:
    """Office-only persistence may never exceed persistence by any record."""
    gap = F.sum("carried_any") - F.sum("carried_office")
    return (
        scores.groupBy("book", "condition")
        .agg(
            _rows().alias("doctors"),
            F.count_if(F.col("carried_office") > F.col("carried_any")).alias("office_above_any"),
            F.count_if(F.col("carried_same") > F.col("carried_office")).alias("same_above_office"),
            signed_share(gap, F.sum("panel")).alias("mean_gap"),
        )
        .orderBy("book", "condition")
    )


def books_separate(records: DataFrame, gates: DataFrame, p: Params) -> DataFrame:
    """The main figures per book, and how many members appear under several.

    A member under two books is counted in each, never across.
    """
    main = F.col("condition") == p.main_family
    pairs = records.where(main).select("book", "member_id").distinct()
    several = pairs.groupBy("member_id").agg(_rows().alias("n")).where(F.col("n") > 1)
    shared = (
        pairs.join(several, "member_id", "left_semi")
        .groupBy("book")
        .agg(_rows().alias("members_in_other_books"))
    )
    return (
        _persistence(gates.where(main))
        .join(shared, "book", "left")
        .withColumn("members_in_other_books", F.coalesce("members_in_other_books", F.lit(0)))
        .withColumn("labelled", F.coalesce(F.col("book").isin(*p.books.values()), F.lit(False)))
        .orderBy("book")
    )


# --- Gate 4: fairness ----------------------------------------------------------


def covariate_balance(
    panel: DataFrame, ranked: DataFrame, age: DataFrame, burden: DataFrame
) -> DataFrame:
    """Patients of flagged against unflagged doctors: means and standardised
    mean difference of age, burden, claim lines and covered months.

    Sums of whole numbers and of their squares are exact in any order; the
    statistics are taken from them once.
    """
    flags = ranked.select(*DOCTOR, "flagged")
    rows = (
        panel.join(flags, DOCTOR)
        .join(age, "member_id", "left")
        .join(burden, ["book", "member_id"], "left")
        .select(
            "book",
            "condition",
            "flagged",
            F.expr(
                "stack(4, 'age', CAST(age AS BIGINT), 'burden', coalesce(burden, 0L),"
                " 'claim_lines', lines, 'covered_months', months) AS (covariate, x)"
            ),
        )
        .where(F.col("x").isNotNull())
    )

    def sums(flag: bool, tag: str) -> list[Column]:
        x = F.when(F.col("flagged") == flag, F.col("x"))
        return [
            F.count(x).alias(f"n_{tag}"),
            F.coalesce(F.sum(x), F.lit(0)).alias(f"s_{tag}"),
            F.coalesce(F.sum(x * x), F.lit(0)).alias(f"q_{tag}"),
        ]

    agg = rows.groupBy("book", "condition", "covariate").agg(*sums(True, "flagged"), *sums(False, "other"))

    def variance(tag: str) -> Column:
        n, s, q = (F.col(f"{k}_{tag}").cast("double") for k in "nsq")
        return F.try_divide(n * q - s * s, n * (n - 1.0))

    def mean(tag: str) -> Column:
        return F.try_divide(F.col(f"s_{tag}").cast("double"), F.col(f"n_{tag}").cast("double"))

    spread = F.sqrt((variance("flagged") + variance("other")) / 2.0)
    return agg.select(
        "book",
        "condition",
        "covariate",
        "n_flagged",
        "n_other",
        share(F.col("s_flagged"), F.col("n_flagged")).alias("mean_flagged"),
        share(F.col("s_other"), F.col("n_other")).alias("mean_other"),
        F.round(F.try_divide(mean("flagged") - mean("other"), spread), 4).alias("standardised_difference"),
    ).orderBy("book", "condition", "covariate")


def sensitivity(doctors: DataFrame, p: Params) -> DataFrame:
    """How far the bottom group depends on the choices made.

    ``doctors`` are counted and standardised under every mention rule; the
    variants are a handful of columns of that table, ranked on the adjusted ratio.
    """
    variants = [(k, m) for k in p.sensitivity_mentions for m in p.sensitivity_panels]
    lines = ", ".join(f"{k}, {m}, confirmed_{k}, panel_{k}, carried_{k}, units_{k}" for k, m in variants)
    long = doctors.select(
        *DOCTOR,
        "specialty",
        F.expr(f"stack({len(variants)}, {lines}) AS (k, min_panel, panel_confirmed, panel, carried_same, units)"),
    )
    group = [*PEERS, "k", "min_panel"]
    peer = long.groupBy(*group).agg(
        F.sum("carried_same").alias("peer_carried"), F.sum("panel").alias("peer_panel")
    )
    ratio = shrunk_ratio(
        F.col("carried_same"), F.col("units"), F.col("peer_carried"), F.col("peer_panel"), p.shrink_weight
    )
    scored = long.where(is_scored(p, F.col("min_panel"))).join(peer, group).withColumn("ratio_units", ratio)
    size = scored.groupBy(*group).agg(_rows().alias("peers"))
    ranked = histogram_rank(scored, group, "ratio_units", "rank").join(size, group)
    low = F.col("rank") <= F.col("peers") * F.lit(float(p.bottom_share))

    def is_variant(k: int, m: int) -> Column:
        return (F.col("k") == k) & (F.col("min_panel") == m)

    def held(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    wide = ranked.groupBy(*DOCTOR).agg(
        *[held(is_variant(k, m) & low).alias(f"low_{k}_{m}") for k, m in variants],
        held(is_variant(p.mentions, p.min_panel) & low).alias("low_base"),
        *[held(is_variant(k, m)).alias(f"in_{k}_{m}") for k, m in variants],
    )
    totals = wide.groupBy("book", "condition").agg(
        F.count_if("low_base").alias("base"),
        *[F.count_if(f"in_{k}_{m}").alias(f"scored_{k}_{m}") for k, m in variants],
        *[F.count_if(f"low_{k}_{m}").alias(f"bottom_{k}_{m}") for k, m in variants],
        *[F.count_if(F.col(f"low_{k}_{m}") & F.col("low_base")).alias(f"both_{k}_{m}") for k, m in variants],
    )
    lines = ", ".join(f"{k}, {m}, scored_{k}_{m}, bottom_{k}_{m}, both_{k}_{m}" for k, m in variants)
    return (
        totals.select(
            "book",
            "condition",
            "base",
            F.expr(f"stack({len(variants)}, {lines}) AS (mentions, min_panel, scored, bottom, in_both)"),
        )
        .select(
            "book",
            "condition",
            "mentions",
            "min_panel",
            "scored",
            "bottom",
            F.col("base").alias("base_bottom"),
            "in_both",
            share(F.col("in_both"), F.col("base")).alias("overlap"),
        )
        .orderBy("book", "condition", "mentions", "min_panel")
    )


# --- limits on the same row as the number ---------------------------------------

# The assumption ids, their status, and what follows if wrong.
ASSUMPTIONS = {
    "A1": ("confirmed", "every diagnosis position is recorded", "the question cannot be answered from this data"),
    "A2": ("confirmed", "a provider is one clinician", "scores describe practices and not people"),
    "A3": ("confirmed", "place of service tells the setting", "office and hospital records cannot be told apart"),
    "A4": ("confirmed", "the commercial book is mixed and reported apart", "nothing more, it is reported apart"),
    "A5": ("assumed", "no retrospective chart review records", "doctors are graded on the work of others"),
    "A6": ("checked by V5", "member identifiers are stable", "conditions drop that did not"),
    "A7": ("checked by V4", "both years are equally complete", "every doctor looks worse in year two"),
    "A8": ("clinically sound", "the condition rarely resolves", "some drops are recoveries"),
    "A9": ("approximate", "the chronic list stands for conditions that persist", "too many conditions are expected to persist"),
    "A10": ("checked by V6", "the visit link is reliable", "conditions are attached to the wrong visits"),
}

FIGURES = {
    "persistence_any": ("A1", "A5", "A6", "A7", "A8", "A10"),
    "persistence_office": ("A1", "A2", "A3", "A5", "A6", "A7", "A8", "A10"),
}


def attach_limits(gates: DataFrame) -> DataFrame:
    """Each figure once per assumption behind it, caveat on the same row."""
    figures = _persistence(gates).select(
        "book",
        "condition",
        F.expr(
            "stack(2, 'persistence_any', persistence_any, 'persistence_office', persistence_office)"
            " AS (figure, value)"
        ),
    )
    limits = F.lit(None)
    for figure, ids in FIGURES.items():
        listed = F.array(
            *[
                F.struct(
                    F.lit(i).alias("assumption"),
                    F.lit(ASSUMPTIONS[i][0]).alias("status"),
                    F.lit(ASSUMPTIONS[i][1]).alias("caveat"),
                    F.lit(ASSUMPTIONS[i][2]).alias("if_wrong"),
                )
                for i in ids
            ]
        )
        limits = F.when(F.col("figure") == figure, listed).otherwise(limits)
    return (
        figures.withColumn("limit", F.explode(limits))
        .select("book", "condition", "figure", "value", "limit.assumption", "limit.status", "limit.caveat", "limit.if_wrong")
        .orderBy("book", "condition", "figure", "assumption")
    )


def batch_submission_shape(
    claim_line: DataFrame, dx_line: DataFrame, codes: DataFrame, p: Params
) -> DataFrame:
    """Records of the main condition, given by its ``codes``, on days without a visit, by month.

    A record is detached when its member has no line in an acceptable setting
    that day.  Batches before deadlines would show as single high months;
    their absence proves nothing.
    """
    in_scope = scope_claims(two_years(claim_line, p), p)
    visits = measured_claims(claim_line, p).select("member_id", "srv_start_dt").distinct()
    coded = dx_line.where(F.col("claim_line_id").isNotNull()).select(
        "claim_line_id", normalise(F.col("icd9_dx_cd")).alias("code")
    )
    per_line = (
        coded.join(codes, "code")
        .groupBy("claim_line_id")
        .agg(_rows().alias("n"))
    )
    detached = (
        in_scope.select("claim_line_id", "book", "member_id", "srv_start_dt")
        .join(per_line, "claim_line_id")
        .join(visits, ["member_id", "srv_start_dt"], "left_anti")
    )
    months = detached.groupBy(
        "book", F.year("srv_start_dt").alias("yr"), F.month("srv_start_dt").alias("mo")
    ).agg(F.sum("n").alias("detached_records"))
    # at most twelve months per book and year
    whole = Window.partitionBy("book", "yr")
    return months.withColumn(
        "share_of_year", share(F.col("detached_records"), F.sum("detached_records").over(whole))
    ).orderBy("book", "yr", "mo")
