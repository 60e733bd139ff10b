"""Oracle SQL for discovery and for checks V1 to V8."""

from __future__ import annotations

from carryover.operators.profile import EXPECTED_ROWS
from carryover.sources.contract import CONTRACTS
from parity.base import P, n, norm, part, share, signed, statement, trim, years

Y1, Y2 = P.years
DIABETES = P.families["diabetes"]

part("mapped", f"""
SELECT diagnosis_code AS raw_code, {norm('diagnosis_code')} AS code, hcc_v24 AS category
FROM code_map WHERE hcc_v24 <> '' AND hcc_v24 <> '0'""")
part("dm_code", f"""
SELECT DISTINCT code FROM mapped WHERE category IN
 (SELECT category FROM mapped WHERE regexp_matches(code, '{DIABETES}'))""")
part("chronic_code", f"""
SELECT DISTINCT {norm('icd_code')} AS code FROM chronic_ref WHERE chronic_indicator = '1'""")
part("dx_code", f"""
SELECT claim_line_id, member_id, TRY_CAST(sequence_id AS INT) AS pos, {norm('icd9_dx_cd')} AS code FROM dx_line""")
part("top_code", f"""
SELECT claim_line_id, member_id, srv_start_dt, {norm('pri_icd9_dx_cd')} AS code FROM claim_line""")
part("pair_lines", f"SELECT * FROM claim_line WHERE {years('srv_start_dt', Y1, Y2)}")
part("per_line", "SELECT claim_line_id, count(*) AS c FROM dx_line GROUP BY ALL")
part("first_pairs", """
SELECT t.claim_line_id, d.code AS dx, t.code AS top FROM dx_code d JOIN top_code t USING (claim_line_id)
WHERE d.pos = 1""")
part("cover", f"""
SELECT member_id, CAST(eff_yr AS INT) AS yr, count(*) AS c, count(DISTINCT CAST(eff_mo AS INT)) AS months
FROM member_month WHERE CAST(eff_yr AS INT) IN ({Y1}, {Y2}) GROUP BY ALL""")
part("line_dx", """
SELECT claim_line_id, count(*) AS dx_rows, count(DISTINCT member_id) AS members, min(member_id) AS first_member
FROM dx_line GROUP BY ALL""")
part("code_rows", """
SELECT code, count(*) AS c FROM dx_code WHERE code <> '' GROUP BY ALL""")
part("known_code", f"""
SELECT {norm('diagnosis_code')} AS code, bool_or(coalesce(hcc_v24 NOT IN ('', '0'), false)) AS has_hcc
FROM code_map WHERE {trim('diagnosis_code')} <> '' GROUP BY ALL""")


def categories(counted: str) -> str:
    return statement(f"""
SELECT category AS hcc_v24, {n(f'count(DISTINCT {counted})')} AS icd_codes,
 array_to_string(list_slice(list_sort(list(DISTINCT code)), 1, 5), ', ') AS example_codes
FROM mapped WHERE regexp_matches(code, '{DIABETES}') GROUP BY category""")


def prevalence(codes: str, name: str) -> str:
    a = "count(*) FILTER (a)"
    b = "count(*) FILTER (b)"
    return statement(f"""
SELECT {n('count(*)')} AS members, {n(b)} AS {name}_pri_icd9_dx_cd, {n(a)} AS {name}_every_position,
 {share(b, 'count(*)')} AS share_pri_icd9_dx_cd, {share(a, 'count(*)')} AS share_every_position,
 {signed(f'{a} - {b}', 'count(*)', 1, 100)} AS diff_pct_points,
 {signed(f'{a} - {b}', b)} AS relative_difference
FROM (SELECT m.member_id,
  m.member_id IN (SELECT c.member_id FROM claim_line c JOIN dx_code d USING (claim_line_id)
    WHERE {years('srv_start_dt', Y1)} AND d.code IN (SELECT code FROM {codes})) AS a,
  m.member_id IN (SELECT member_id FROM top_code
    WHERE {years('srv_start_dt', Y1)} AND code IN (SELECT code FROM {codes})) AS b
  FROM (SELECT DISTINCT member_id FROM member_month
        WHERE eff_yr = '{Y1}' AND upper({trim('mbr_state')}) = '{P.state}') m)""")


def profile(table: str, columns: list[str]) -> str:
    return statement(" UNION ALL ".join(f"""
SELECT '{table}.{c}' AS profiled, coalesce(CAST({c} AS VARCHAR), '(null)') AS raw_value, count(*) AS n_rows,
 {share('count(*)', f'(SELECT count(*) FROM {table})')} AS share FROM {table} GROUP BY {c}""" for c in columns))


# Column order and Spark types of the fixture views.
VIEW_COLUMNS = {
    "dx_line": "claim_line_id:bigint sequence_id:string icd9_dx_cd:string member_id:bigint poa_cd:string",
    "claim_line": "claim_line_id:bigint member_id:bigint srv_start_dt:date pri_icd9_dx_cd:string plc_srv_cd:string"
    " plc_srv_ctg_cd:string med_cost_ctg_cd:string business_ln_cd:string srv_prvdr_id:bigint prcdr_cd:string"
    " allowed_amt:double summarized_srv_ind:string duplicate_ind:string ntwk_srv_area_id:string"
    " member_county_cd:string",
    "code_map": "diagnosis_code:string hcc_v24:string",
    "member_month": "member_id:bigint eff_yr:string eff_mo:string mbr_state:string age_nbr:bigint"
    " gender_cd:string mbr_county_cd:string mbr_submarket:string",
    "provider": "provider_id:bigint epdb_dw_prvdr_id:string specialty_ctg_cd:string zip_cd:string"
    " county_nm:string tin_owner_nm:string",
    "curated_claims": "claim_line_id:bigint member_id:bigint age_nbr:bigint gender_cd:string mbr_submarket:string"
    " srv_start_dt:date pri_icd9_dx_cd:string business_ln_cd:string epdb_dw_prvdr_id:bigint"
    " prvdr_submarket:string specialty_ctg_cd:string",
    "chronic_ref": "icd_code:string icd_description:string chronic_indicator:string",
}


def _columns(table: str) -> str:
    fields = {f.name: f for f in CONTRACTS[table]}
    out = []
    for i, item in enumerate(VIEW_COLUMNS[table].split()):
        c, kind = item.split(":")
        listed = fields[c].role in ("key", "code", "day")
        distinct = n(f"count(DISTINCT {c})") if listed else "CAST(NULL AS BIGINT)"
        # a double prints differently in the two engines
        length = f"CAST(max(length(CAST({c} AS VARCHAR))) AS BIGINT)" if kind != "double" else "CAST(NULL AS BIGINT)"
        out.append(f"""
SELECT 'input' AS dataset_searched, '{table}' AS table_name, {i + 1} AS ordinal_position, '{c}' AS column_name,
 '{fields[c].type}' AS declared_type, '{kind}' AS data_type, count(*) > count({c}) AS is_nullable,
 count(*) AS n_rows, count(*) - count({c}) AS null_rows, {distinct} AS distinct_values, {length} AS max_length
FROM {table}""")
    return " UNION ALL ".join(out)


def _listing(table: str) -> str:
    return statement(f"""
SELECT ordinal_position, column_name, data_type, n_rows, null_rows FROM ({_columns(table)})""")


def _volume(tables) -> str:
    return statement(" UNION ALL ".join(f"""
SELECT 'input' AS dataset_searched, '{t}' AS table_name, count(*) AS row_count,
 CAST({EXPECTED_ROWS.get(t, 'NULL')} AS BIGINT) AS expected_rows,
 {share('count(*)', str(EXPECTED_ROWS[t])) if t in EXPECTED_ROWS else 'CAST(NULL AS DOUBLE)'} AS share_of_expected
FROM {t}""" for t in tables))


def _shape(side: str, table: str, column: str) -> str:
    return f"""
SELECT '{side}' AS side, CAST(length({trim(column)}) AS INT) AS raw_length, contains({column}, '.') AS has_dot,
 count(DISTINCT {column}) AS distinct_codes, count(*) AS n_rows FROM {table} WHERE {trim(column)} <> ''
GROUP BY ALL"""


FOUNDATION: dict[str, str] = {
    "column_profile": statement(" UNION ALL ".join(_columns(t) for t in VIEW_COLUMNS)),
    "table_volume": _volume(VIEW_COLUMNS),
    "curated_column_profile": _listing("curated_claims"),
    "curated_table_volume": _volume(["curated_claims"]),
    "v1_sequence_values": statement(f"""
SELECT pos AS sequence_id, count(*) AS dx_rows, count(DISTINCT claim_line_id) AS claim_lines,
 {share('count(*)', '(SELECT count(*) FROM dx_line)')} AS share_of_rows FROM dx_code GROUP BY pos"""),
    "v2_dx_per_line_summary": statement(f"""
SELECT count(*) AS claim_lines, {n('sum(c)')} AS dx_rows, {share('sum(c)', 'count(*)', 2)} AS avg_dx_per_claim_line,
 {share('count(*) FILTER (c = 1)', 'count(*)')} AS share_exactly_one,
 {share('count(*) FILTER (c > 10)', 'count(*)')} AS share_over_ten, max(c) AS max_dx_per_claim_line FROM per_line"""),
    "v2_dx_per_line_distribution": statement(f"""
SELECT c AS dx_per_claim_line, count(*) AS claim_lines,
 {share('count(*)', '(SELECT count(*) FROM per_line)')} AS share_of_claim_lines FROM per_line GROUP BY c"""),
    "v3_seq1_agreement": statement(f"""
SELECT count(*) AS compared_rows, count(DISTINCT claim_line_id) AS compared_claim_lines,
 count(*) FILTER (dx = top) AS agree, count(*) FILTER (dx <> top) AS disagree,
 count(*) FILTER (dx IS NULL OR top IS NULL) AS null_either,
 {share('count(*) FILTER (dx = top)', 'count(*)')} AS agreement FROM first_pairs"""),
    "v3_disagreeing_pairs": statement("""
SELECT dx AS icd9_dx_cd_seq1, top AS pri_icd9_dx_cd, count(*) AS n_rows FROM first_pairs WHERE dx <> top
GROUP BY ALL ORDER BY n_rows DESC, dx, top LIMIT 200"""),
    "v4_monthly_volume": statement(f"""
SELECT CAST(year(srv_start_dt) AS INT) AS yr, CAST(month(srv_start_dt) AS INT) AS mo, count(*) AS claim_lines,
 count(DISTINCT member_id) AS members FROM claim_line
WHERE year(srv_start_dt) BETWEEN {P.first_year} AND {P.last_year} GROUP BY ALL"""),
    "v4_q4_ratio": statement(f"""
WITH q AS (SELECT CAST(year(srv_start_dt) AS INT) AS yr, count(*) AS c FROM claim_line
 WHERE year(srv_start_dt) BETWEEN {P.first_year} AND {P.last_year} AND month(srv_start_dt) >= 10 GROUP BY ALL)
SELECT a.yr AS year_1, b.yr AS year_2, a.c AS q4_year_1, b.c AS q4_year_2, {share('b.c', 'a.c')} AS q4_ratio,
 abs(b.c / a.c - 1) <= 0.10 AS within_10pct
FROM q b JOIN q a ON a.yr = (SELECT max(yr) FROM q WHERE yr < b.yr)""".replace("WITH q AS", "SELECT * FROM (WITH q AS", 1) + ")"),
    "v5_membership_grain": statement("""
SELECT c AS rows_in_year, months AS distinct_months, count(*) AS member_years FROM cover
GROUP BY ALL ORDER BY member_years DESC, c, months LIMIT 100"""),
    "v5_presence_pivot": statement(f"""
WITH m AS (SELECT member_id, coalesce(max(months) FILTER (yr = {Y1}), 0) AS a,
 coalesce(max(months) FILTER (yr = {Y2}), 0) AS b FROM cover GROUP BY ALL)
SELECT count(*) FILTER (a > 0) AS members_{Y1}, count(*) FILTER (a > 0 AND b > 0) AS in_both_years,
 count(*) FILTER (a > 0 AND b = 0) AS only_{Y1}, count(*) FILTER (a = 0 AND b > 0) AS new_{Y2},
 count(*) FILTER (a = 12) AS full_12m_{Y1}, count(*) FILTER (a = 12 AND b > 0) AS full_{Y1}_present_{Y2},
 count(*) FILTER (a = 12 AND b = 12) AS full_12m_both,
 {share('count(*) FILTER (a > 0 AND b > 0)', 'count(*) FILTER (a > 0)')} AS share_present_{Y2},
 {share('count(*) FILTER (a = 12 AND b > 0)', 'count(*) FILTER (a = 12)')} AS share_full_{Y1}_present_{Y2} FROM m""".replace("WITH m AS", "SELECT * FROM (WITH m AS", 1) + ")"),
    "v5_claims_vs_coverage": statement(f"""
SELECT yr, count(*) AS claim_members, count(*) FILTER (known) AS matched_to_coverage,
 count(*) FILTER (NOT known) AS no_coverage_row, {share('count(*) FILTER (NOT known)', 'count(*)')} AS share_no_coverage_row
FROM (SELECT DISTINCT CAST(year(p.srv_start_dt) AS INT) AS yr, p.member_id,
 EXISTS (SELECT 1 FROM cover v WHERE v.member_id = p.member_id AND v.yr = year(p.srv_start_dt)) AS known
 FROM pair_lines p) GROUP BY yr"""),
    "v6_join_integrity": statement(f"""
SELECT count(*) AS claim_lines, count(d.dx_rows) AS matched, count(*) - count(d.dx_rows) AS unmatched,
 {share('count(d.dx_rows)', 'count(*)')} AS match_rate, count(*) FILTER (l.member_id <> d.first_member) AS member_mismatch,
 count(*) FILTER (d.members > 1) AS multi_member_lines
FROM pair_lines l LEFT JOIN line_dx d USING (claim_line_id)"""),
    "v6_mismatch_sample": statement("""
SELECT l.claim_line_id, l.member_id AS claim_member_id, d.first_member AS dx_member_id, d.dx_rows,
 d.members AS distinct_members FROM pair_lines l JOIN line_dx d USING (claim_line_id)
WHERE l.member_id <> d.first_member OR d.members > 1 ORDER BY 1, 2 LIMIT 500"""),
    "v7_diabetes_codes": categories("raw_code"),
    "v7_diabetes_share": prevalence("dm_code", "diabetes"),
    "chronic_share": prevalence("chronic_code", "chronic"),
    "v8_code_shapes": statement(
        _shape("dx_line.icd9_dx_cd", "dx_line", "icd9_dx_cd")
        + " UNION ALL "
        + _shape("code_map.diagnosis_code", "code_map", "diagnosis_code")
    ),
    "v8_match_rate": statement(f"""
SELECT count(*) AS distinct_claim_codes, count(k.code) AS matched_codes, count(*) - count(k.code) AS unmatched_codes,
 {share('count(k.code)', 'count(*)')} AS match_rate_by_code, {n('sum(c)')} AS dx_rows,
 {share('sum(c) FILTER (k.code IS NOT NULL)', 'sum(c)')} AS match_rate_by_volume,
 count(*) FILTER (has_hcc) AS codes_with_hcc_v24,
 {share('sum(c) FILTER (has_hcc)', 'sum(c)')} AS share_of_rows_with_hcc_v24
FROM code_rows r LEFT JOIN known_code k ON k.code = r.code"""),
    "v8_unmatched_codes": statement("""
SELECT code AS icd9_dx_cd, c AS dx_rows FROM code_rows WHERE code NOT IN (SELECT code FROM known_code)
ORDER BY c DESC, code LIMIT 500"""),
    "profile_plc_srv_cd": profile("claim_line", ["plc_srv_cd"]),
    "profile_plc_srv_ctg_cd": profile("claim_line", ["plc_srv_ctg_cd"]),
    "profile_med_cost_ctg_cd": profile("claim_line", ["med_cost_ctg_cd"]),
    "profile_poa_cd": profile("dx_line", ["poa_cd"]),
    "profile_mbr_state": profile("member_month", ["mbr_state"]),
    "profile_specialty_ctg_cd": profile("provider", ["specialty_ctg_cd"]),
    "value_profile": profile("claim_line", ["plc_srv_cd", "plc_srv_ctg_cd", "med_cost_ctg_cd"]),
    "eda_grain_distribution": statement("""
SELECT c AS rows_per_claim_line_id, count(*) AS claim_line_ids
FROM (SELECT count(*) AS c FROM curated_claims GROUP BY claim_line_id) GROUP BY c"""),
    "eda_grain_totals": statement("""
SELECT count(*) AS n_rows, count(DISTINCT claim_line_id) AS distinct_claim_line_ids,
 count(*) - count(claim_line_id) AS null_claim_line_id_rows FROM curated_claims"""),
    "eda_dx_probe": statement(f"""
SELECT count(*) AS probe_lines, count(*) FILTER (hit) AS matched_lines,
 {share('count(*) FILTER (hit)', 'count(*)')} AS match_rate, count(*) FILTER (other) AS lines_member_disagree,
 count(*) FILTER (missing) AS dx_member_null_lines
FROM (SELECT k.id, count(x.claim_line_id) > 0 AS hit, bool_or(CAST(x.member_id AS VARCHAR) <> k.member) AS other,
  bool_or(x.claim_line_id IS NOT NULL AND x.member_id IS NULL) AS missing
 FROM (SELECT CAST(claim_line_id AS VARCHAR) AS id, min(CAST(member_id AS VARCHAR)) AS member FROM curated_claims
   WHERE claim_line_id IS NOT NULL GROUP BY 1 ORDER BY md5(id), id LIMIT {P.probe_lines}) k
 LEFT JOIN dx_line x ON CAST(x.claim_line_id AS VARCHAR) = k.id GROUP BY k.id)"""),
    "eda_business_line": statement("""
SELECT coalesce(business_ln_cd, '(null)') AS business_ln_cd, count(*) AS n_rows, count(DISTINCT member_id) AS members
FROM curated_claims GROUP BY 1"""),
    "eda_submarket_cardinality": statement(" UNION ALL ".join(f"""
SELECT '{c}' AS profiled, count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS null_rows, count(*) AS n_rows
FROM curated_claims""" for c in ("mbr_submarket", "prvdr_submarket"))),
    "eda_submarket_top10": statement(" UNION ALL ".join(f"""
(SELECT '{c}' AS profiled, coalesce({c}, '(null)') AS raw_value, count(*) AS n_rows FROM curated_claims GROUP BY {c}
 ORDER BY n_rows DESC, raw_value LIMIT 10)""" for c in ("mbr_submarket", "prvdr_submarket"))),
    "eda_year_range": statement("""
SELECT CAST(year(srv_start_dt) AS INT) AS yr, count(*) AS claim_lines, min(srv_start_dt) AS min_srv_start_dt,
 max(srv_start_dt) AS max_srv_start_dt FROM curated_claims GROUP BY 1"""),
    "eda_dm_codes": categories("code"),
}
