"""Oracle SQL for the measure, the doctor scores and gates 2 to 4."""

from __future__ import annotations

from carryover.functions.columns import Z95
from carryover.operators.gates import ASSUMPTIONS, FIGURES
from carryover.operators.measure import GATES
from parity.base import P, n, norm, part, share, signed, statement, years
from parity.foundation import FOUNDATION

Y1, Y2 = P.years
MAIN, CONTROL = P.main_family, P.control_family
UNIT = "book, condition, member_id"
DOCTOR = "book, condition, provider_id"
EXCLUDED = ", ".join(f"'{x}'" for x in P.excluded_sources)
BOOK = "CASE business_ln_cd " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.books.items()) + " END"
SETTING = (
    "CASE plc_srv_cd " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.settings.items()) + " ELSE 'unassigned' END"
)


def yr(c: str = "srv_start_dt") -> str:
    return f"CAST(year({c}) AS INT)"


part("scoped", f"SELECT *, {BOOK} AS book, {SETTING} AS setting FROM claim_line WHERE {BOOK} IS NOT NULL")
part("scoped_pair", f"SELECT * FROM scoped WHERE {years('srv_start_dt', Y1, Y2)}")
part("usable", f"""
SELECT * FROM scoped_pair WHERE setting <> 'unassigned' AND coalesce(med_cost_ctg_cd, '') NOT IN ({EXCLUDED})""")
part("fam_code", " UNION ALL ".join(f"""
SELECT DISTINCT '{name}' AS condition, category, code FROM mapped
WHERE category IN (SELECT category FROM mapped WHERE regexp_matches(code, '{pattern}'))"""
    for name, pattern in P.families.items()))
part("rec", f"""
SELECT c.claim_line_id, c.book, c.member_id, c.srv_start_dt, {yr('c.srv_start_dt')} AS yr, c.srv_prvdr_id, c.setting,
 h.condition, h.category
FROM usable c JOIN (SELECT DISTINCT d.claim_line_id, f.condition, f.category FROM dx_code d JOIN fam_code f USING (code)) h
 USING (claim_line_id)""")
part("my", f"""
SELECT {UNIT}, yr, true AS recorded_anywhere, bool_or(setting = 'office') AS recorded_office FROM rec GROUP BY ALL""")
part("summ", f"""
SELECT {UNIT}, count(DISTINCT srv_start_dt) FILTER (yr = {Y1}) AS mentions,
 count(DISTINCT (srv_start_dt, srv_prvdr_id)) FILTER (yr = {Y1}) AS visits,
 bool_or(yr = {Y2}) AS carried_any, bool_or(yr = {Y2} AND setting = 'office') AS carried_office
FROM rec GROUP BY {UNIT}""")
part("contact", f"""
SELECT member_id, count(*) AS lines, bool_or(year(srv_start_dt) = {Y2}) AS seen FROM pair_lines GROUP BY member_id""")
# a patient stays with a doctor whose lines, but for laboratory and dental ones, fall in both years
part("stayed", f"""
SELECT DISTINCT a.member_id, srv_prvdr_id AS provider_id FROM pair_lines a JOIN pair_lines b USING (member_id, srv_prvdr_id)
WHERE year(a.srv_start_dt) = {Y1} AND year(b.srv_start_dt) = {Y2}
 AND coalesce(a.med_cost_ctg_cd, '') NOT IN ('LAB', 'DENTAL') AND coalesce(b.med_cost_ctg_cd, '') NOT IN ('LAB', 'DENTAL')""")
part("held", "SELECT member_id, sum(months) AS months FROM cover GROUP BY member_id")
part("flags", f"""
SELECT s.book, s.condition, s.member_id, s.mentions, s.carried_any, s.carried_office,
 NOT EXISTS (SELECT 1 FROM member_death d WHERE d.member_id = s.member_id AND d.death_dt <= DATE '{Y2}-12-31') AS alive,
 {n('coalesce(h.months, 0)')} AS months, coalesce(h.months, 0) = 24 AS covered,
 coalesce(c.lines, 0) AS lines, coalesce(c.seen, false) AS seen,
 s.member_id IN (SELECT member_id FROM stayed) AS same_doctor
FROM summ s LEFT JOIN held h USING (member_id) LEFT JOIN contact c USING (member_id)""")
part("judgement", """
SELECT *, CASE WHEN NOT alive THEN 'death' WHEN NOT covered THEN 'coverage' WHEN NOT seen THEN 'no_visit'
 WHEN NOT same_doctor THEN 'changed_doctor' END AS gate,
 alive AND covered AND seen AND same_doctor AS judged FROM flags""")
part("gates", f"SELECT * FROM judgement WHERE mentions >= {P.mentions}")
part("own", f"""
SELECT {UNIT}, srv_prvdr_id AS provider_id, bool_or(yr = {Y2}) AS carried_same FROM rec
WHERE setting = 'office' AND srv_prvdr_id IS NOT NULL GROUP BY ALL HAVING bool_or(yr = {Y1})""")
# each doctor is judged on the members who stayed with that doctor
part("every_pan", f"""
SELECT g.* REPLACE (g.judged AND EXISTS (SELECT 1 FROM stayed s WHERE s.member_id = g.member_id AND s.provider_id = o.provider_id) AS judged),
 o.provider_id, o.carried_same FROM judgement g JOIN own o USING ({UNIT})""")
part("pan", f"SELECT * FROM every_pan WHERE mentions >= {P.mentions}")
part("spec", "SELECT provider_id, min(specialty_ctg_cd) AS specialty FROM provider GROUP BY provider_id")


def score_columns(where: str = "judged") -> str:
    return ", ".join(f"count(*) FILTER ({where} AND {c}) AS {c}" for c in ("carried_any", "carried_office", "carried_same"))


part("doc", f"""
SELECT p.book, p.condition, p.provider_id, coalesce(any_value(s.specialty), '(none)') AS specialty,
 count(*) AS panel_confirmed, count(*) FILTER (judged) AS panel, {score_columns()}
FROM pan p LEFT JOIN spec s USING (provider_id) GROUP BY p.book, p.condition, p.provider_id""")
W = P.shrink_weight
part("shrunk", f"""
SELECT d.book, d.condition, d.provider_id, d.specialty, d.panel_confirmed, d.panel, d.carried_same,
 q.pc AS peer_carried, q.pp AS peer_panel, {share('d.carried_same', 'd.panel')} AS score_same,
 {share('q.pc', 'q.pp')} AS peer_rate,
 CAST((20000 * (d.carried_same * q.pp + {W} * q.pc) + q.pp * (d.panel + {W})) // (2 * q.pp * (d.panel + {W})) AS BIGINT) AS shrunk_units
FROM doc d JOIN (SELECT book, condition, specialty, {n('sum(carried_same)')} AS pc, {n('sum(panel)')} AS pp FROM doc GROUP BY ALL) q
 USING (book, condition, specialty) WHERE d.panel_confirmed >= {P.min_panel} AND d.panel > 0""")
part("age_of", f"SELECT member_id, max(age_nbr) AS age FROM member_month WHERE CAST(eff_yr AS INT) = {Y1} GROUP BY ALL")
part("burden_of", f"""
SELECT u.book, u.member_id, count(DISTINCT m.category) AS burden FROM usable u JOIN dx_code d USING (claim_line_id)
 JOIN mapped m ON m.code = d.code WHERE year(u.srv_start_dt) = {Y1} GROUP BY ALL""")
RULES = sorted({P.mentions, *P.sensitivity_mentions})
part("cells", f"""
SELECT v.k AS rule, p.book, p.condition, p.provider_id, coalesce(s.specialty, '(none)') AS specialty, coalesce(a.age // 10, -1) AS age_band,
 least(coalesce(b.burden, 0), 5) AS burden_band, count(*) AS sure, count(*) FILTER (judged) AS c, count(*) FILTER (judged AND carried_same) AS k
FROM every_pan p JOIN (VALUES {', '.join(f'({k})' for k in RULES)}) AS v(k) ON p.mentions >= v.k
 LEFT JOIN spec s USING (provider_id) LEFT JOIN age_of a USING (member_id)
 LEFT JOIN burden_of b USING (book, member_id) GROUP BY ALL""")
part("std", f"""
SELECT rule, book, condition, provider_id, specialty, {n('sum(sure)')} AS panel_confirmed, {n('sum(c)')} AS panel, {n('sum(k)')} AS carried_same,
 {n('coalesce(sum(c * rate), 0)')} AS units
FROM cells JOIN (SELECT rule, book, condition, specialty, age_band, burden_band, CASE WHEN sum(c) > 0 THEN {n('(2000000 * sum(k) + sum(c)) // (2 * sum(c))')} END AS rate
  FROM cells GROUP BY ALL) USING (rule, book, condition, specialty, age_band, burden_band) GROUP BY rule, book, condition, provider_id, specialty""")
part("ratios", f"""
SELECT *, CASE WHEN units + m > 0 THEN CAST((20000 * (carried_same * 1000000 + m) + units + m) // (2 * (units + m)) AS BIGINT) END AS ratio_units
FROM (SELECT t.*, q.pc AS peer_carried, q.pp AS peer_panel, {W} * ((2000000 * q.pc + q.pp) // (2 * q.pp)) AS m
 FROM std t JOIN (SELECT rule, book, condition, specialty, {n('sum(carried_same)')} AS pc, {n('sum(panel)')} AS pp FROM std GROUP BY ALL) q
  USING (rule, book, condition, specialty))""")
part("flagged_docs", f"""
SELECT *, coalesce(rank <= peers * {P.bottom_share}, false) AS flagged FROM (
SELECT *, {share('carried_same', 'panel')} AS score_same, {share('peer_carried', 'peer_panel')} AS peer_rate, ratio_units / 10000.0 :: DOUBLE AS adjusted_ratio,
 CASE WHEN ratio_units IS NOT NULL THEN {n('rank() OVER (PARTITION BY book, condition, specialty ORDER BY ratio_units)')} END AS rank,
 count(*) OVER (PARTITION BY book, condition, specialty) AS peers
FROM ratios WHERE rule = {P.mentions} AND panel_confirmed >= {P.min_panel} AND panel > 0)""")
part("listed", f"""
SELECT {norm('diagnosis_code')} AS code, CASE WHEN hcc_v24 IN ('', '0') OR hcc_v24 IS NULL THEN 'no category' ELSE hcc_v24 END AS status,
 valid_from, coalesce(valid_to, DATE '9999-12-31') AS valid_to FROM code_version""")
part("family_main", f"SELECT DISTINCT code FROM fam_code WHERE condition = '{MAIN}'")


def persistence(where: str = "true") -> str:
    a, o = "count(*) FILTER (carried_any)", "count(*) FILTER (carried_office)"
    return f"""
SELECT book, condition, count(*) AS judged, {a} AS carried_any, {o} AS carried_office,
 {share(a, 'count(*)')} AS persistence_any, {share(o, 'count(*)')} AS persistence_office
FROM gates WHERE judged AND {where} GROUP BY book, condition"""


def histories(ends: tuple[str, ...], members: int) -> str:
    picks = " UNION ALL ".join(f"""
(SELECT '{end}' AS doctor_end, p.book, p.provider_id AS scored_provider_id, e.adjusted_ratio, p.member_id, p.carried_same
 FROM pan p JOIN (SELECT * FROM flagged_docs WHERE condition = '{MAIN}' QUALIFY row_number() OVER (PARTITION BY book
  ORDER BY ratio_units {'ASC' if end == 'lowest' else 'DESC'}, provider_id) <= {P.extreme_doctors}) e USING (book, condition, provider_id) WHERE p.judged
 ORDER BY md5(CAST(p.member_id AS VARCHAR)), p.member_id, p.provider_id LIMIT {members})""" for end in ends)
    return statement(f"""
SELECT k.doctor_end, k.book, k.scored_provider_id, k.adjusted_ratio, k.member_id, k.carried_same, c.srv_start_dt, c.claim_line_id,
 c.srv_prvdr_id, {SETTING.replace('plc_srv_cd', 'c.plc_srv_cd')} AS setting, d.pos AS position, d.code,
 coalesce(d.code IN (SELECT code FROM family_main), false) AS in_family
FROM ({picks}) k JOIN pair_lines c USING (member_id) LEFT JOIN dx_code d USING (claim_line_id)""")


def attrition(where: str = "true") -> str:
    rows, left = [f"""SELECT book, condition, 0 AS gate_order, 'confirmed' AS gate, true AS applied, 0 AS removed,
 count(*) AS remaining, 0.0 :: DOUBLE AS share_removed FROM gates GROUP BY book, condition"""], []
    for i, gate in enumerate(GATES):
        left.append(f"'{gate}'")
        hit = f"count(*) FILTER (gate = '{gate}')"
        rows.append(f"""SELECT book, condition, {i + 1}, '{gate}', true, {hit},
 count(*) - count(*) FILTER (gate IN ({', '.join(left)})), {share(hit, 'count(*)')} FROM gates GROUP BY book, condition""")
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE {where}"


part("attr", attrition())


def stage(i: int, name: str, fans: bool, source: str, count: str = "count(*)") -> str:
    return f"""SELECT book, {i} AS stage_order, '{name}' AS stage, {str(fans).lower()} AS fan_out_intended,
 {n(count)} AS n_rows, count(DISTINCT member_id) AS members FROM {source} GROUP BY book"""


part("stage_counts", " UNION ALL ".join([
    stage(1, "claim lines", False, "scoped_pair"),
    stage(2, "line x position", True, "scoped_pair JOIN per_line USING (claim_line_id)", "sum(c)"),
    stage(3, "condition records", False, f"(SELECT * FROM rec WHERE condition = '{MAIN}')"),
    stage(4, "member x year", False, f"(SELECT * FROM my WHERE condition = '{MAIN}')"),
    stage(5, "confirmed members", False, f"(SELECT * FROM gates WHERE condition = '{MAIN}')"),
    stage(6, "judgeable members", False, f"(SELECT * FROM gates WHERE condition = '{MAIN}' AND judged)"),
]))
part("reconciled", """
SELECT a.*, NOT coalesce((a.n_rows > b.n_rows AND NOT a.fan_out_intended) OR a.members > b.members, false) AS accounted_for
FROM stage_counts a LEFT JOIN stage_counts b ON b.book = a.book AND b.stage_order = a.stage_order - 1""")
part("removal", "SELECT *, share_removed > 1.0 :: DOUBLE / 3.0 :: DOUBLE AS must_be_explained FROM attr WHERE gate_order > 0")
part("off_any", f"""
SELECT book, condition, count(*) AS doctors, count(*) FILTER (carried_office > carried_any) AS office_above_any,
 count(*) FILTER (carried_same > carried_office) AS same_above_office,
 {signed('sum(carried_any) - sum(carried_office)', 'sum(panel)')} AS mean_gap FROM doc GROUP BY book, condition""")


def wilson(sign: str) -> str:
    k, m = "CAST(carried_same AS DOUBLE)", "CAST(panel AS DOUBLE)"
    z2 = f"({Z95 * Z95!r} :: DOUBLE)"
    return f"""round((({k} + {z2} / 2.0 :: DOUBLE) {sign} {Z95!r} :: DOUBLE * sqrt({k} * ({m} - {k}) / {m} + {z2} / 4.0 :: DOUBLE)) / ({m} + {z2}), 4)"""


def _round(x: str) -> str:
    return f"round({x}, 4)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


EXPECTED = " OR ".join(
    f"(specialty = '{k}' AND setting NOT IN ({', '.join(repr(x) for x in v)}))" for k, v in P.specialty_settings.items()
)
KNOWN = ", ".join(f"'{k}'" for k in P.specialty_settings)
part("setting_lines", f"""
SELECT s.book, s.setting, coalesce(p.specialty, '(none)') AS specialty FROM scoped_pair s
 LEFT JOIN spec p ON p.provider_id = s.srv_prvdr_id WHERE coalesce(s.med_cost_ctg_cd, '') NOT IN ({EXCLUDED})""")
part("setting_sum", f"""
SELECT book, count(*) AS lines, {share("count(*) FILTER (setting = 'unassigned')", 'count(*)')} AS share_unassigned,
 {share("count(*) FILTER (setting = 'office')", '(SELECT coalesce(max(k), 1) FROM (SELECT count(*) AS k FROM setting_lines i WHERE i.book = o.book AND i.setting <> $$office$$ GROUP BY i.setting))')} AS office_lead,
 {share(f"count(*) FILTER ({EXPECTED})", f"count(*) FILTER (specialty IN ({KNOWN}))")} AS share_disagree
FROM setting_lines o GROUP BY book""")
part("mention_sums", f"""
SELECT book, condition, count(*) FILTER (mentions >= {P.mentions}) AS n1, count(*) FILTER (mentions >= {P.mentions} AND carried_any) AS c1,
 count(*) FILTER (mentions < {P.mentions}) AS n2, count(*) FILTER (mentions < {P.mentions} AND carried_any) AS c2
FROM summ WHERE mentions > 0 GROUP BY book, condition""")
_GAP = f"({dbl('c1')} / nullif({dbl('n1')}, 0) - {dbl('c2')} / nullif({dbl('n2')}, 0))"
_RATE = f"(({dbl('c1')} + {dbl('c2')}) / nullif({dbl('n1')} + {dbl('n2')}, 0))"
part("mention_test", f"""
SELECT book, condition, {_round(_GAP)} AS difference,
 {_round(f"{_GAP} / nullif(sqrt({_RATE} * (1.0 :: DOUBLE - {_RATE}) * (1.0 :: DOUBLE / nullif({dbl('n1')}, 0) + 1.0 :: DOUBLE / nullif({dbl('n2')}, 0))), 0)")} AS z
FROM mention_sums""")
part("histogram_rows", f"""
SELECT book, condition, CAST(least(carried_any * 20 // panel, 19) AS INT) AS bucket, count(*) AS doctors,
 count(*) FILTER (carried_any = 0) AS at_zero, count(*) FILTER (carried_any = panel) AS at_hundred
FROM doc WHERE panel_confirmed >= {P.min_panel} AND panel > 0 GROUP BY ALL""")
def byar(sign: str) -> str:
    m = "CAST(carried_same AS DOUBLE)" if sign == "-" else "(CAST(carried_same AS DOUBLE) + 1.0 :: DOUBLE)"
    root = f"(1.0 :: DOUBLE - 1.0 :: DOUBLE / ({m} * 9.0 :: DOUBLE) {sign} {Z95!r} :: DOUBLE / (sqrt({m}) * 3.0 :: DOUBLE))"
    return f"""CASE WHEN units > 0 THEN round(CASE WHEN {m} > 0 THEN {m} * {root} * {root} * {root} ELSE 0.0 :: DOUBLE END
 / (CAST(units AS DOUBLE) / 1000000.0 :: DOUBLE), 4) END"""


part("bins", """
SELECT g.book, g.condition, r.b AS bucket, coalesce(h.doctors, 0) AS d FROM (SELECT DISTINCT book, condition FROM histogram_rows) g
 CROSS JOIN (SELECT CAST(unnest(range(20)) AS INT) AS b) r
 LEFT JOIN histogram_rows h ON h.book = g.book AND h.condition = g.condition AND h.bucket = r.b""")
part("dips", f"""
SELECT book, condition, max(CASE WHEN low > d THEN {share('low - d', 'low')} END) AS dip FROM (
SELECT a.book, a.condition, a.bucket, a.d, least((SELECT max(d) FROM bins l WHERE l.book = a.book AND l.condition = a.condition AND l.bucket < a.bucket),
 (SELECT max(d) FROM bins r WHERE r.book = a.book AND r.condition = a.condition AND r.bucket > a.bucket)) AS low
FROM bins a WHERE a.bucket BETWEEN 1 AND 18) GROUP BY book, condition""")
part("shape", f"""
SELECT h.book, h.condition, {n('sum(h.doctors)')} AS doctors, {share('sum(h.at_zero) + sum(h.at_hundred)', 'sum(h.doctors)')} AS end_share,
 coalesce(any_value(d.dip), 0.0 :: DOUBLE) AS dip_share
FROM histogram_rows h LEFT JOIN dips d ON d.book = h.book AND d.condition = h.condition GROUP BY h.book, h.condition""")
_P1, _P2 = "(CAST(control_carried AS DOUBLE) / nullif(control_judged, 0))", "(CAST(main_carried AS DOUBLE) / nullif(main_judged, 0))"
_ERR = f"sqrt({_P1} * (1.0 :: DOUBLE - {_P1}) / nullif(CAST(control_judged AS DOUBLE), 0) + {_P2} * (1.0 :: DOUBLE - {_P2}) / nullif(CAST(main_judged AS DOUBLE), 0))"
part("control_rows", f"""
SELECT *, {share('main_carried', 'main_judged')} AS main_persistence, {share('control_carried', 'control_judged')} AS control_persistence,
 {signed('control_carried * main_judged - main_carried * control_judged', 'main_judged * control_judged')} AS control_minus_main,
 round({_P1} - {_P2} - {Z95!r} :: DOUBLE * {_ERR}, 4) AS difference_low, round({_P1} - {_P2} + {Z95!r} :: DOUBLE * {_ERR}, 4) AS difference_high
FROM (SELECT book, count(*) FILTER (judged AND condition = '{MAIN}') AS main_judged,
 count(*) FILTER (judged AND carried_any AND condition = '{MAIN}') AS main_carried,
 count(*) FILTER (judged AND condition = '{CONTROL}') AS control_judged,
 count(*) FILTER (judged AND carried_any AND condition = '{CONTROL}') AS control_carried FROM gates GROUP BY book)""")
part("survival", f"""
SELECT *, coalesce(enough_patients AND interval_high < peer_rate AND ratio_high < 1.0, false) AS survives FROM (
SELECT {DOCTOR}, specialty, panel, score_same, {wilson('-')} AS interval_low, {wilson('+')} AS interval_high, peer_rate, adjusted_ratio,
 {byar('-')} AS ratio_low, {byar('+')} AS ratio_high, panel >= {P.min_panel} AS enough_patients FROM flagged_docs WHERE flagged)""")

COVARIATES = {"age": "age", "burden": "coalesce(burden, 0)", "claim_lines": "lines", "covered_months": "months"}
part("cov_rows", " UNION ALL ".join(f"""
SELECT p.book, p.condition, f.flagged, '{name}' AS covariate, CAST({x} AS BIGINT) AS x FROM pan p
 JOIN flagged_docs f USING ({DOCTOR}) LEFT JOIN age_of a USING (member_id) LEFT JOIN burden_of b USING (book, member_id)
WHERE {x} IS NOT NULL""" for name, x in COVARIATES.items()))


def _d(k: str, tag: str) -> str:
    return f"CAST({k}_{tag} AS DOUBLE)"


def _var(t: str) -> str:
    return f"(({_d('n', t)} * {_d('q', t)} - {_d('s', t)} * {_d('s', t)}) / nullif({_d('n', t)} * ({_d('n', t)} - 1.0 :: DOUBLE), 0))"


def _mean(t: str) -> str:
    return f"({_d('s', t)} / nullif({_d('n', t)}, 0))"


part("balance", f"""
SELECT book, condition, covariate, n_f AS n_flagged, n_o AS n_other, {share('s_f', 'n_f')} AS mean_flagged,
 {share('s_o', 'n_o')} AS mean_other,
 round(({_mean('f')} - {_mean('o')}) / nullif(sqrt(({_var('f')} + {_var('o')}) / 2.0 :: DOUBLE), 0), 4) AS standardised_difference
FROM (SELECT book, condition, covariate,
 {', '.join(f"count(*) FILTER ({c}) AS n_{t}, {n(f'coalesce(sum(x) FILTER ({c}), 0)')} AS s_{t}, {n(f'coalesce(sum(x * x) FILTER ({c}), 0)')} AS q_{t}" for t, c in (('f', 'flagged'), ('o', 'NOT flagged')))}
 FROM cov_rows GROUP BY ALL)""")


def _variant(k: int, m: int) -> str:
    return f"""
SELECT {k} AS mentions, {m} AS min_panel, book, condition, provider_id, coalesce(ratio_units IS NOT NULL AND
 rank() OVER (PARTITION BY book, condition, specialty ORDER BY ratio_units)
 <= {P.bottom_share} * count(*) OVER (PARTITION BY book, condition, specialty), false) AS low
FROM ratios WHERE rule = {k} AND panel_confirmed >= {m} AND panel > 0"""


VARIANTS = [(k, m) for k in P.sensitivity_mentions for m in P.sensitivity_panels]
part("variant_docs", " UNION ALL ".join(_variant(k, m) for k, m in VARIANTS))
part("base_low", f"""
SELECT {DOCTOR} FROM variant_docs WHERE low AND mentions = {P.mentions} AND min_panel = {P.min_panel}""")
part("overlap_rows", f"""
SELECT g.book, g.condition, v.mentions, v.min_panel, count(d.provider_id) AS scored, count(*) FILTER (d.low) AS bottom,
 (SELECT count(*) FROM base_low b WHERE b.book = g.book AND b.condition = g.condition) AS base_bottom,
 count(*) FILTER (d.low AND (d.book, d.condition, d.provider_id) IN (SELECT ({DOCTOR}) FROM base_low)) AS in_both
FROM (SELECT DISTINCT book, condition FROM variant_docs) g
 CROSS JOIN (VALUES {', '.join(f'({k}, {m})' for k, m in VARIANTS)}) AS v(mentions, min_panel)
 LEFT JOIN variant_docs d ON d.book = g.book AND d.condition = g.condition AND d.mentions = v.mentions AND d.min_panel = v.min_panel
GROUP BY g.book, g.condition, v.mentions, v.min_panel""")
part("limits", " UNION ALL ".join(
    f"SELECT '{figure}' AS figure, '{i}' AS assumption, '{ASSUMPTIONS[i][0]}' AS status, '{ASSUMPTIONS[i][1]}' AS caveat, '{ASSUMPTIONS[i][2]}' AS if_wrong"
    for figure, ids in FIGURES.items() for i in ids))
part("figure_limits", f"""
SELECT p.book, p.condition, l.figure, CASE l.figure WHEN 'persistence_any' THEN p.persistence_any ELSE p.persistence_office END AS value,
 l.assumption, l.status, l.caveat, l.if_wrong FROM ({persistence()}) p CROSS JOIN limits l""")

MEASUREMENT: dict[str, str] = {
    "curate_claims": statement(f"""
SELECT c.claim_line_id, c.member_id, m.age_nbr, m.gender_cd, m.mbr_county_cd, m.mbr_submarket, c.srv_start_dt,
 c.pri_icd9_dx_cd, c.prcdr_cd, c.allowed_amt, c.business_ln_cd, p.epdb_dw_prvdr_id, p.county_nm AS prvdr_county,
 CAST(NULL AS VARCHAR) AS prvdr_submarket, p.specialty_ctg_cd
FROM claim_line c LEFT JOIN member_month m ON m.member_id = c.member_id AND CAST(m.eff_yr AS INT) = year(c.srv_start_dt)
  AND CAST(m.eff_mo AS INT) = month(c.srv_start_dt) LEFT JOIN provider p ON p.provider_id = c.srv_prvdr_id
WHERE c.summarized_srv_ind = 'Y' AND c.duplicate_ind = 'N' AND c.med_cost_ctg_cd <> 'DENTAL' AND c.ntwk_srv_area_id <> 'DPPO'"""),
    "build_member_month": statement("""
SELECT member_id, strftime(eff_dt, '%Y') AS eff_yr, strftime(eff_dt, '%m') AS eff_mo, age_nbr, gender_cd, mbr_county_cd,
 mbr_state, mbr_submarket, business_ln_cd FROM member_raw WHERE medical_ind = 'Y' AND business_ln_cd IN ('CP', 'ME')"""),
    "scope_claims": statement("SELECT claim_line_id, member_id, srv_start_dt, business_ln_cd, book FROM scoped"),
    "expand_positions": statement("""
SELECT p.claim_line_id, p.member_id, p.srv_start_dt, p.plc_srv_cd, d.pos AS position, d.code
FROM pair_lines p JOIN dx_code d USING (claim_line_id)"""),
    "label_conditions": statement("""
SELECT p.claim_line_id, p.member_id, d.pos AS position, d.code, f.condition, f.category
FROM pair_lines p JOIN dx_code d USING (claim_line_id) JOIN fam_code f ON f.code = d.code"""),
    "classify_setting": statement(f"SELECT claim_line_id, plc_srv_cd, {SETTING} AS setting FROM claim_line"),
    "exclude_sources": statement(
        f"SELECT claim_line_id, med_cost_ctg_cd FROM claim_line WHERE coalesce(med_cost_ctg_cd, '') NOT IN ({EXCLUDED})"
    ),
    "condition_records": statement("SELECT * FROM rec"),
    "confirm_two_mentions": statement(f"SELECT {UNIT}, mentions FROM summ WHERE mentions >= {P.mentions}"),
    "confirm_two_visits": statement(f"SELECT {UNIT}, visits AS mentions FROM summ WHERE visits >= {P.mentions}"),
    "member_year": statement("SELECT * FROM my"),
    "hospital_sustained": statement(f"""
SELECT book, condition, yr, count(*) AS member_years, count(*) FILTER (NOT recorded_office) AS hospital_only,
 {share('count(*) FILTER (NOT recorded_office)', 'count(*)')} AS share_hospital_only FROM my GROUP BY ALL"""),
    "two_year_outcome": statement(
        f"SELECT {UNIT}, mentions, carried_any, carried_office FROM summ WHERE mentions >= {P.mentions}"
    ),
    "gate_death": statement(f"SELECT {UNIT}, alive FROM gates"),
    "gate_coverage": statement(f"SELECT {UNIT}, months, covered FROM gates"),
    "gate_same_doctor": statement(f"SELECT {UNIT}, same_doctor FROM gates"),
    "flag_no_visit": statement(f"SELECT {UNIT}, lines, seen FROM gates"),
    "gate_code_family": statement(f"""
SELECT book, condition, count(*) AS confirmed, count(*) FILTER (carried_any) AS carried_family,
 count(*) FILTER (same) AS carried_same_category,
 count(*) FILTER (carried_any) - count(*) FILTER (same) AS moved_within_family,
 {share('count(*) FILTER (carried_any) - count(*) FILTER (same)', 'count(*)')} AS share_moved
FROM (SELECT s.*, EXISTS (SELECT 1 FROM rec a JOIN rec b USING ({UNIT}, category) WHERE a.yr = {Y1} AND b.yr = {Y2}
  AND a.book = s.book AND a.condition = s.condition AND a.member_id = s.member_id) AS same
 FROM summ s WHERE mentions >= {P.mentions}) GROUP BY book, condition"""),
    "gated_outcome": statement("SELECT * FROM gates"),
    "attrition": statement("SELECT * FROM attr"),
    "condition_incidence": statement(f"""
SELECT b.book, f.condition, count(*) AS at_risk, count(*) FILTER (s.carried_any) AS newly_recorded,
 {share('count(*) FILTER (s.carried_any)', 'count(*)')} AS incidence
FROM (SELECT DISTINCT book, member_id FROM scoped_pair WHERE member_id IN (SELECT member_id FROM held WHERE months = 24)) b
 CROSS JOIN (VALUES {', '.join(f"('{f}')" for f in P.families)}) AS f(condition)
 LEFT JOIN summ s ON s.book = b.book AND s.member_id = b.member_id AND s.condition = f.condition
WHERE coalesce(s.mentions, 0) = 0 GROUP BY b.book, f.condition"""),
    "provider_scores": statement(f"""
SELECT *, {share('carried_any', 'panel')} AS score_any, {share('carried_office', 'panel')} AS score_office,
 {share('carried_same', 'panel')} AS score_same FROM doc"""),
    "min_panel": statement("SELECT *, " + ", ".join(
        f"CASE WHEN ok THEN {share('carried_' + c, 'panel')} END AS score_{c}" for c in ("any", "office", "same")
    ) + f""", CASE WHEN ok THEN 'scored' ELSE 'not enough to tell' END AS status
FROM (SELECT *, panel_confirmed >= {P.min_panel} AND panel > 0 AS ok FROM doc)""").replace(
        "\nSELECT *, CASE WHEN ok", "\nSELECT * EXCLUDE (ok), CASE WHEN ok"
    ),
    "shrink_scores": statement("SELECT *, shrunk_units / 10000.0 :: DOUBLE AS shrunk_score FROM shrunk"),
    "peer_compare": statement(f"""
SELECT {DOCTOR}, specialty, panel, carried_same AS observed, {share('units', '1000000', 2)} AS expected,
 {share('carried_same * 1000000', 'units')} AS observed_to_expected, {byar('-')} AS ratio_low, {byar('+')} AS ratio_high
FROM std WHERE rule = {P.mentions} AND panel > 0"""),
    "rank_scores": statement(f"""
SELECT {DOCTOR}, specialty, panel, score_same, {share('units', '1000000', 2)} AS expected, adjusted_ratio, rank, peers, flagged FROM flagged_docs"""),
    "final_list": statement(f"""
SELECT {DOCTOR}, specialty, panel, score_same, interval_high, peer_rate, adjusted_ratio, ratio_high FROM survival WHERE survives"""),
    "case_timelines": histories(("lowest",), P.case_members),
    "v9_stage_reconcile": statement("SELECT * FROM reconciled"),
    "v10_collapse_unique": statement(f"""
SELECT {n('coalesce(sum(c), 0)')} AS member_years, count(*) FILTER (c > 1) AS repeated_keys,
 (SELECT count(*) FROM (SELECT {UNIT}, yr FROM my EXCEPT SELECT {UNIT}, yr FROM rec)) +
 (SELECT count(*) FROM (SELECT {UNIT}, yr FROM rec EXCEPT SELECT {UNIT}, yr FROM my)) AS lost_or_invented_keys
FROM (SELECT {UNIT}, yr, count(*) AS c FROM my GROUP BY ALL)"""),
    "v11_setting_agreement": statement(f"""
SELECT book, setting, specialty, count(*) AS n_rows,
 {share('count(*)', 'CAST(sum(count(*)) OVER (PARTITION BY book, specialty) AS BIGINT)')} AS share_of_specialty,
 {share('count(*)', 'CAST(sum(count(*)) OVER (PARTITION BY book) AS BIGINT)')} AS share_of_rows
FROM (SELECT s.book, s.setting, coalesce(p.specialty, '(none)') AS specialty FROM scoped_pair s
 LEFT JOIN spec p ON p.provider_id = s.srv_prvdr_id WHERE coalesce(s.med_cost_ctg_cd, '') NOT IN ({EXCLUDED}))
GROUP BY book, setting, specialty"""),
    "v12_excluded_absent": statement(f"""
SELECT count(DISTINCT claim_line_id) AS measured_lines, count(DISTINCT claim_line_id) FILTER (claim_line_id IN
 (SELECT claim_line_id FROM claim_line WHERE med_cost_ctg_cd IN ({EXCLUDED}))) AS excluded_lines FROM rec"""),
    "v13_retired_codes": statement(f"""
SELECT *, CASE WHEN rows_year_1 > 0 AND rows_year_2 > 0 THEN 'both years' WHEN rows_year_1 > 0 THEN 'year 1 only'
 ELSE 'year 2 only' END AS "use",
 CASE WHEN status_before = status_after THEN 'unchanged' WHEN status_after = 'not listed' THEN 'retired'
 WHEN status_before = 'not listed' THEN 'new' ELSE 'moved' END AS change
FROM (SELECT u.*, coalesce(a.status, 'not listed') AS status_before, coalesce(b.status, 'not listed') AS status_after
FROM (SELECT d.code, count(*) FILTER (year(s.srv_start_dt) = {Y1}) AS rows_year_1,
 count(*) FILTER (year(s.srv_start_dt) = {Y2}) AS rows_year_2, d.code IN (SELECT code FROM known_code) AS mapped
 FROM scoped_pair s JOIN dx_code d USING (claim_line_id)
 WHERE regexp_matches(d.code, '{P.families[MAIN]}') OR d.code IN (SELECT code FROM family_main) GROUP BY d.code) u
 LEFT JOIN (SELECT code, arg_max(status, valid_from) AS status FROM listed
  WHERE DATE '{Y1}-01-01' BETWEEN valid_from AND valid_to GROUP BY code) a ON a.code = u.code
 LEFT JOIN (SELECT code, arg_max(status, valid_from) AS status FROM listed
  WHERE DATE '{Y2}-12-31' BETWEEN valid_from AND valid_to GROUP BY code) b ON b.code = u.code)"""),
    "v14_two_mention_effect": statement(f"""
SELECT book, condition, mention_group, count(*) AS members, count(*) FILTER (carried_any) AS carried_any,
 count(*) FILTER (carried_office) AS carried_office, {share('count(*) FILTER (carried_any)', 'count(*)')} AS persistence,
 {share('count(*)', 'CAST(sum(count(*)) OVER (PARTITION BY book, condition) AS BIGINT)')} AS share_of_members
FROM (SELECT *, CASE WHEN mentions >= {P.mentions} THEN 'confirmed' ELSE 'too few mentions' END AS mention_group
 FROM summ WHERE mentions > 0) GROUP BY book, condition, mention_group"""),
    "v15_gate_removal": statement("SELECT * FROM removal"),
    "v16_population_rate": statement(f"""
SELECT *, CASE WHEN persistence_any > 0.95 THEN 'implausibly high' WHEN persistence_any < 0.5 THEN 'implausibly low'
 WHEN persistence_any BETWEEN 0.65 AND 0.85 THEN 'within' ELSE 'near' END AS band FROM ({persistence(f"condition = '{MAIN}'")})"""),
    "v17_score_distribution": statement("""
SELECT a.book, a.condition, a.bucket, a.bucket / 20.0 :: DOUBLE AS from_score, a.doctors, a.at_zero, a.at_hundred,
 a.doctors > coalesce(l.doctors, 0) AND a.doctors >= coalesce(r.doctors, 0) AS is_peak
FROM histogram_rows a LEFT JOIN histogram_rows l ON l.book = a.book AND l.condition = a.condition AND l.bucket = a.bucket - 1
 LEFT JOIN histogram_rows r ON r.book = a.book AND r.condition = a.condition AND r.bucket = a.bucket + 1"""),
    "v18_extreme_histories": histories(("lowest", "highest"), P.extreme_members),
    "v19_control_condition": statement("SELECT * FROM control_rows"),
    "v11_setting_summary": statement("SELECT * FROM setting_sum"),
    "v14_two_mention_test": statement("SELECT * FROM mention_test"),
    "v17_score_shape": statement("SELECT * FROM shape"),
    "v20_office_vs_any": statement("SELECT * FROM off_any"),
    "v21_books_separate": statement(f"""
SELECT p.*, (SELECT count(DISTINCT a.member_id) FROM rec a WHERE a.book = p.book AND a.condition = '{MAIN}' AND a.member_id IN
 (SELECT member_id FROM rec b WHERE b.book <> p.book AND b.condition = '{MAIN}')) AS members_in_other_books, true AS labelled
FROM ({persistence(f"condition = '{MAIN}'")}) p"""),
    "v22_flag_survival": statement("SELECT * FROM survival"),
    "v23_covariate_balance": statement("SELECT * FROM balance"),
    "v24_sensitivity": statement(f"SELECT *, {share('in_both', 'base_bottom')} AS overlap FROM overlap_rows"),
    "v26_attach_limits": statement("SELECT * FROM figure_limits"),
    "batch_submission_shape": statement(f"""
SELECT book, yr, mo, count(*) AS detached_records,
 {share('count(*)', 'CAST(sum(count(*)) OVER (PARTITION BY book, yr) AS BIGINT)')} AS share_of_year
FROM (SELECT s.book, {yr('s.srv_start_dt')} AS yr, CAST(month(s.srv_start_dt) AS INT) AS mo
 FROM scoped_pair s JOIN dx_code d USING (claim_line_id) WHERE d.code IN (SELECT code FROM family_main)
 AND NOT EXISTS (SELECT 1 FROM usable u WHERE u.member_id = s.member_id AND u.srv_start_dt = s.srv_start_dt))
GROUP BY book, yr, mo"""),
}


#: Written by hand: the figures of each result table, and which of the two sets of assumptions is behind them.
_BEHIND = {
    "condition_incidence": {"any": ("incidence",)},
    "provider_scores": {"any": ("score_any",), "office": ("score_office", "score_same")},
    "ranking": {"office": ("score_same", "expected", "adjusted_ratio")},
    "peer_compare": {"office": ("expected", "observed_to_expected", "ratio_low", "ratio_high")},
    "final_list": {"office": ("score_same", "interval_high", "peer_rate", "adjusted_ratio", "ratio_high")},
    "v16_population_rate": {"any": ("persistence_any",), "office": ("persistence_office",)},
    "v17_score_shape": {"any": ("end_share", "dip_share")},
    "v19_control_condition": {"any": ("main_persistence", "control_persistence", "control_minus_main")},
    "v20_office_vs_any": {"office": ("mean_gap",)},
    "v21_books_separate": {"any": ("persistence_any",), "office": ("persistence_office",)},
    "v22_flag_survival": {"office": ("score_same", "interval_low", "interval_high", "ratio_low", "ratio_high")},
    "v23_covariate_balance": {"office": ("standardised_difference",)},
    "v24_sensitivity": {"office": ("overlap",)},
}
_SETS = {"any": "'A1', 'A5', 'A6', 'A7', 'A8', 'A10'", "office": "'A1', 'A2', 'A3', 'A5', 'A6', 'A7', 'A8', 'A10'"}
_KNOWN = ", ".join(f"('{i}', '{a}', '{b}', '{c}')" for i, (a, b, c) in ASSUMPTIONS.items())
MEASUREMENT["figure_limits"] = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{figure}' AS figure, * FROM (VALUES {_KNOWN}) AS k(assumption, status, caveat, if_wrong)"
    f" WHERE assumption IN ({_SETS[which]})"
    for table, sets in _BEHIND.items()
    for which, figures in sets.items()
    for figure in figures
)
_ROWS_OF = {
    "condition_incidence": MEASUREMENT["condition_incidence"],
    "provider_scores": statement("SELECT book, condition, provider_id FROM doc"),
    "ranking": statement("SELECT * FROM flagged_docs"),
    "peer_compare": MEASUREMENT["peer_compare"],
    "final_list": statement("SELECT * FROM survival WHERE survives"),
    "v16_population_rate": statement(persistence(f"condition = '{MAIN}'")),
    "v17_score_shape": statement("SELECT * FROM shape"),
    "v19_control_condition": statement("SELECT * FROM control_rows"),
    "v20_office_vs_any": statement("SELECT * FROM off_any"),
    "v21_books_separate": statement(persistence(f"condition = '{MAIN}'")),
    "v22_flag_survival": statement("SELECT * FROM survival"),
    "v23_covariate_balance": statement("SELECT * FROM balance"),
    "v24_sensitivity": statement("SELECT * FROM overlap_rows"),
}
_BOOKS = statement(f"SELECT DISTINCT book FROM gates WHERE judged AND condition = '{MAIN}'")
MEASUREMENT["results_checked"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, count(*) AS n_rows, CAST(0 AS BIGINT) AS repeated_keys,
 count(*) FILTER (book IS NULL OR book NOT IN ('medicare', 'commercial')) AS unlabelled_rows,
 {f"(SELECT count(*) FROM ({_BOOKS}) b WHERE b.book NOT IN (SELECT book FROM ({sql})))" if name in ("v16_population_rate", "v20_office_vs_any", "v21_books_separate") else "CAST(0 AS BIGINT)"} AS missing_books
FROM ({sql})"""
    for name, sql in _ROWS_OF.items()
)


# --- verdicts ------------------------------------------------------------------


def _metric(check: str, metric: str, value: str, source: str) -> str:
    return f"SELECT '{check}' AS check_, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value FROM ({source})"


def _of(name: str) -> str:
    return {**FOUNDATION, **MEASUREMENT}[name]


_MAIN = f"condition = '{MAIN}'"
_FOUND = [
    _metric("EDA_0b", "max_rows_per_line", "max(rows_per_claim_line_id)", _of("eda_grain_distribution")),
    *[_metric("EDA_0c", c, c, _of("eda_dx_probe")) for c in ("match_rate", "lines_member_disagree")],
    _metric("EDA_1", "categories", "count(*)", _of("eda_dm_codes")),
    _metric("V1", "max_position", "max(sequence_id)", _of("v1_sequence_values")),
    *[
        _metric("V2", c, c, _of("v2_dx_per_line_summary"))
        for c in ("share_exactly_one", "avg_dx_per_claim_line", "share_over_ten")
    ],
    _metric("V3", "agreement", "agreement", _of("v3_seq1_agreement")),
    _metric(
        "V4", "within_10pct", f"count(*) FILTER (within_10pct AND year_1 = {Y1} AND year_2 = {Y2})", _of("v4_q4_ratio")
    ),
    _metric("V5", "share_full_present", f"share_full_{Y1}_present_{Y2}", _of("v5_presence_pivot")),
    *[
        _metric("V6", c, c, _of("v6_join_integrity"))
        for c in ("match_rate", "member_mismatch", "multi_member_lines")
    ],
    _metric("V7", "diff_pct_points", "diff_pct_points", _of("v7_diabetes_share")),
    _metric("V8", "match_rate_by_code", "match_rate_by_code", _of("v8_match_rate")),
]
_LATER = [
    _metric("V9", "stages_not_accounted_for", "CASE WHEN count(*) > 0 THEN count(*) FILTER (NOT accounted_for) END", "SELECT * FROM reconciled"),
    _metric("V10", "repeated_keys", "CASE WHEN member_years > 0 THEN repeated_keys END", _of("v10_collapse_unique")),
    _metric("V11", "share_unassigned", "max(share_unassigned)", "SELECT * FROM setting_sum"),
    _metric("V11", "office_lead", "min(office_lead)", "SELECT * FROM setting_sum"),
    _metric("V11", "share_disagree", "max(share_disagree)", "SELECT * FROM setting_sum"),
    _metric("V13", "codes_changed", "count(*) FILTER (change <> 'unchanged')", _of("v13_retired_codes")),
    _metric("V14", "difference", "min(difference)", f"SELECT * FROM mention_test WHERE {_MAIN}"),
    _metric("V14", "z", "min(z)", f"SELECT * FROM mention_test WHERE {_MAIN}"),
    _metric("V17", "end_share", "max(end_share)", f"SELECT * FROM shape WHERE {_MAIN}"),
    _metric("V17", "dip_share", "max(dip_share)", f"SELECT * FROM shape WHERE {_MAIN}"),
    _metric("V19", "control_minus_main", "max(control_minus_main)", "SELECT * FROM control_rows"),
    _metric("V19", "difference_high", "max(difference_high)", "SELECT * FROM control_rows"),
    _metric("V12", "excluded_lines", "CASE WHEN measured_lines > 0 THEN excluded_lines END", _of("v12_excluded_absent")),
    _metric("V15", "largest_share_removed", "max(share_removed)", f"SELECT * FROM attr WHERE {_MAIN}"),
    _metric("V16", "persistence", "arg_max(persistence_any, abs(persistence_any - 0.75))", persistence(_MAIN)),
    _metric("V20", "office_above_any", "sum(office_above_any)", "SELECT * FROM off_any"),
    _metric("V10", "lost_or_invented_keys", "CASE WHEN member_years > 0 THEN lost_or_invented_keys END", _of("v10_collapse_unique")),
    _metric("V21", "unlabelled_figures", "CASE WHEN count(*) > 0 THEN count(*) FILTER (book IS NULL) END", persistence(_MAIN)),
    _metric("V21", "repeated_result_keys", "CASE WHEN count(*) > 0 THEN 0 END", persistence(_MAIN)),
    _metric("V22", "unsupported", "CASE WHEN count(*) > 0 THEN 0 END", "SELECT * FROM flagged_docs"),
    _metric("V22", "left_out", "CASE WHEN count(*) > 0 THEN 0 END", "SELECT * FROM flagged_docs"),
    _metric("V23", "largest_difference", "max(abs(standardised_difference))", f"SELECT * FROM balance WHERE {_MAIN}"),
    _metric("V24", "smallest_overlap", "min(overlap)", f"{_of('v24_sensitivity')} WHERE {_MAIN}"),
    _metric("V26", "figures_without_limits", "CASE WHEN count(*) > 0 THEN count(*) FILTER (assumption IS NULL) END", "SELECT * FROM figure_limits"),
]
#: Written by hand: check, metric, when it fails, when it passes, whether it blocks, what to do.
RULES_BY_HAND = [
    ("EDA_0b", "max_rows_per_line", "value > 1", "value <= 1", True, "stop before the probe"),
    ("EDA_0c", "match_rate", "value < 0.95", "value >= 0.95", True, "stop everything"),
    ("EDA_0c", "lines_member_disagree", "value > 0", "value = 0", True, "stop everything"),
    ("EDA_1", "categories", "value < 1", "value >= 1", True, "stop"),
    ("V1", "max_position", "value <= 1", "value > 1", True, "stop everything"),
    ("V2", "share_exactly_one", "value > 0.90", "value <= 0.90", False, "compare with V1"),
    ("V2", "avg_dx_per_claim_line", "value < 1", "value > 1", False, "compare with V1"),
    ("V2", "share_over_ten", "value < 0", "value > 0", False, "compare with V1"),
    ("V3", "agreement", "value < 0.80", "value > 0.95", True, "read the disagreeing pairs"),
    ("V4", "within_10pct", "value < 1", "value >= 1", False, "move the window back a year"),
    ("V5", "share_full_present", "value < 0.85", "value >= 0.95", False, "build a crosswalk"),
    ("V6", "match_rate", "value < 0.90", "value > 0.95", True, "stop"),
    ("V6", "member_mismatch", "value > 0", "value = 0", True, "stop"),
    ("V6", "multi_member_lines", "value > 0", "value = 0", True, "stop"),
    ("V7", "diff_pct_points", "value <= 0", "value >= 1", True, "stop and report"),
    ("V8", "match_rate_by_code", "value < 0.90", "value > 0.95", False, "compare the code shapes"),
    ("V9", "stages_not_accounted_for", "value > 0", "value = 0", True, "fix and rebuild"),
    ("V10", "repeated_keys", "value > 0", "value = 0", True, "fix and rebuild"),
    ("V10", "lost_or_invented_keys", "value > 0", "value = 0", True, "fix and rebuild"),
    ("V11", "share_unassigned", "value > 0", "value = 0", False, "read the unassigned places of service"),
    ("V11", "office_lead", "value < 1", "value > 1", False, "read the settings by specialty"),
    ("V11", "share_disagree", "value > 0.20", "value <= 0.05", False, "read the settings by specialty"),
    ("V12", "excluded_lines", "value > 0", "value = 0", True, "fix and rebuild"),
    ("V13", "codes_changed", "value > 0", "value = 0", False, "map old codes to new before comparing"),
    ("V14", "difference", "value <= 0", "value >= 0.05", False, "reconsider the mention rule"),
    ("V14", "z", "value <= 0", "value > 1.96", False, "reconsider the mention rule"),
    ("V15", "largest_share_removed", "value > 1", "value <= 1.0 :: DOUBLE / 3.0 :: DOUBLE", True, "explain the gate"),
    ("V16", "persistence", "value < 0.50 OR value > 0.95", "value BETWEEN 0.65 AND 0.85", True, "investigate"),
    ("V17", "end_share", "value > 0.25", "value <= 0.10", False, "look for small panels and data faults"),
    ("V17", "dip_share", "value > 0.50", "value <= 0.25", False, "look for two populations"),
    ("V19", "control_minus_main", "value > 0.15", "value <= 0.05", False, "weaken the claim"),
    ("V19", "difference_high", "value > 0.30", "value <= 0.10", False, "weaken the claim"),
    ("V20", "office_above_any", "value > 0", "value = 0", True, "the build is wrong"),
    ("V21", "unlabelled_figures", "value > 0", "value = 0", False, "label every figure"),
    ("V21", "repeated_result_keys", "value > 0", "value = 0", False, "label every figure"),
    ("V22", "unsupported", "value > 0", "value = 0", True, "remove them from the list"),
    ("V22", "left_out", "value > 0", "value = 0", True, "remove them from the list"),
    ("V23", "largest_difference", "value > 0.25", "value <= 0.1", True, "adjust or claim less"),
    ("V24", "smallest_overlap", "value < 0.5", "value >= 0.8", True, "report consistent doctors only"),
    ("V26", "figures_without_limits", "value > 0", "value = 0", True, "attach them"),
]
_FOUND_CHECKS = ["EDA_0b", "EDA_0c", "EDA_1", "V1", "V2", "V3", "V4", "V5", "V6", "V7", "V8"]


def _decided(metrics: list[str], checks: list[str] | None) -> str:
    """Metric, bound and verdict; each rule as its own comparison."""
    rows = [
        f"""
SELECT '{check}' AS "check", '{metric}' AS metric, value, CASE WHEN value IS NULL THEN 'UNVERIFIABLE' WHEN {bad} THEN 'FAIL'
 WHEN {good} THEN 'PASS' ELSE 'REVIEW' END AS verdict, {str(blocks).lower()} AS blocks, '{action}' AS on_failure
FROM (SELECT max(value) AS value FROM metric_values WHERE check_ = '{check}' AND metric = '{metric}')"""
        for check, metric, bad, good, blocks, action in RULES_BY_HAND
        if checks is None or check in checks
    ]
    return f"WITH metric_values AS ({' UNION ALL '.join(metrics)}) {' UNION ALL '.join(rows)}"


_ORDER = "CASE verdict WHEN 'PASS' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'UNVERIFIABLE' THEN 2 WHEN 'FAIL' THEN 3 END"
_WORST = f"arg_max(verdict, {_ORDER})"
_BY_HAND = """SELECT 'V18', 'UNVERIFIABLE', true, 'stop and find out why' UNION ALL
 SELECT 'V25', 'UNVERIFIABLE', true, 'rewrite before circulation'"""
_CHECKS = f"""
SELECT "check", {_WORST} AS verdict, bool_or(blocks) AS blocks, min(on_failure) AS on_failure
FROM (SELECT "check", verdict, blocks, on_failure FROM ({_decided(_FOUND + _LATER, None)}) UNION ALL {_BY_HAND}) GROUP BY 1"""
_NEEDS = ", ".join(f"('{g}', '{c}')" for g, checks in (
    ("1 foundation", ("V1", "V3", "V6", "V7")), ("2 build", ("V9", "V10", "V12", "V15")),
    ("3 plausibility", ("V16", "V18", "V20")), ("4 fairness", ("V22", "V23", "V24", "V25", "V26")),
) for c in checks)

MEASUREMENT["foundation_verdicts"] = f"SELECT * FROM ({_decided(_FOUND, _FOUND_CHECKS)})"
MEASUREMENT["check_verdicts"] = statement(f"SELECT * FROM ({_CHECKS})")
MEASUREMENT["gate_signoff"] = statement(f"""
SELECT gate, count(*) AS checks, {', '.join(f"count(*) FILTER (verdict = '{v}') AS {v.lower()}" for v in ('PASS', 'REVIEW', 'UNVERIFIABLE', 'FAIL'))},
 {_WORST} AS verdict, bool_and(bool_and(verdict = 'PASS')) OVER (ORDER BY gate) AS signed_off
FROM (VALUES {_NEEDS}) AS g(gate, check_name) LEFT JOIN ({_CHECKS}) c ON c."check" = g.check_name GROUP BY gate""")
