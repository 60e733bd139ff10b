"""The logical tables as views over the TPC-H-like test tables.

The text is written in the SQL that Spark and DuckDB share, with ``{name}``
for a table, so the oracle and the queries start from the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from carryover.lazy import Lazy
from carryover.params import Params

DRIVER_TABLES = ("customer", "supplier", "part", "orders", "lineitem")


def _code(key: str) -> str:
    """A made-up diagnosis code: three in ten in the diabetes block."""
    return (
        f"(CASE WHEN {key} % 10 < 3 THEN 'E'"
        f" ELSE substr('ABCDFGHIJKLM', CAST({key} % 12 AS INT) + 1, 1) END"
        f" || lpad(CAST(CASE WHEN {key} % 10 < 3 THEN 8 + {key} % 6"
        f" ELSE 10 + {key} % 89 END AS STRING), 2, '0')"
        f" || '.' || CAST({key} % 7 AS STRING))"
    )


# In dependency order.
VIEWS: dict[str, str] = {
    "code_map": f"""
SELECT replace({_code('p_partkey')}, '.', '') AS diagnosis_code,
 CASE WHEN p_partkey % 10 < 3 THEN CASE p_partkey % 7 WHEN 0 THEN '17' WHEN 1 THEN '18' ELSE '19' END
      WHEN p_partkey % 10 = 5 THEN '85' WHEN p_partkey % 10 = 6 THEN '0'
      WHEN p_partkey % 10 = 7 THEN '' ELSE NULL END AS hcc_v24
 FROM {{part}} WHERE {_code('p_partkey')} NOT LIKE 'K%'""",
    "dx_line": f"""
SELECT l.l_orderkey AS claim_line_id,
 CASE WHEN l.l_partkey % 701 = 0 THEN 'XX' ELSE lpad(CAST(l.l_linenumber AS STRING), 2, '0') END AS sequence_id,
 CASE WHEN l.l_partkey % 333 = 0 THEN ' ' ELSE lower({_code('l.l_partkey')}) END AS icd9_dx_cd,
 CASE WHEN l.l_partkey % 501 = 0 THEN NULL
      WHEN l.l_partkey % 1601 = 0 OR l.l_orderkey % 701 = 0 THEN o.o_custkey + 1 ELSE o.o_custkey END AS member_id,
 l.l_returnflag AS poa_cd
 FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey""",
    "claim_line": f"""
SELECT o.o_orderkey AS claim_line_id, o.o_custkey AS member_id, CAST(o.o_orderdate AS DATE) AS srv_start_dt,
 CASE WHEN o.o_orderkey % 40 = 0 OR s.pk IS NULL THEN {_code('o.o_orderkey')} ELSE {_code('s.pk')} END AS pri_icd9_dx_cd,
 CASE WHEN o.o_orderkey % 10 < 6 THEN 'F' WHEN o.o_orderkey % 10 < 8 THEN 'OP'
      WHEN o.o_orderkey % 10 = 8 THEN 'IP' ELSE NULL END AS plc_srv_cd,
 CASE WHEN o.o_orderkey % 10 < 6 THEN 'P' WHEN o.o_orderkey % 10 < 9 THEN 'H' ELSE ' ' END AS plc_srv_ctg_cd,
 CASE WHEN o.o_orderkey % 23 = 0 THEN 'LAB' WHEN o.o_orderkey % 29 = 0 THEN 'DENTAL' ELSE 'MED' END AS med_cost_ctg_cd,
 CASE WHEN o.o_orderstatus = 'P' THEN 'CP' ELSE 'ME' END AS business_ln_cd,
 CASE WHEN o.o_orderkey % 5 = 0 THEN o.o_orderkey % 12 ELSE o.o_custkey % 12 END AS srv_prvdr_id,
 'P' || CAST(o.o_orderkey % 97 AS STRING) AS prcdr_cd,
 o.o_totalprice AS allowed_amt,
 CASE WHEN o.o_orderkey % 31 = 0 THEN 'N' ELSE 'Y' END AS summarized_srv_ind,
 CASE WHEN o.o_orderkey % 41 = 0 THEN 'Y' ELSE 'N' END AS duplicate_ind,
 CASE WHEN o.o_orderkey % 43 = 0 THEN 'DPPO' ELSE 'N' || CAST(o.o_orderkey % 4 AS STRING) END AS ntwk_srv_area_id,
 'C' || CAST(o.o_custkey % 67 AS STRING) AS member_county_cd
 FROM {{orders}} o LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM {{lineitem}}
   WHERE l_linenumber = 1 GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey""",
    "member_month": """
SELECT c.c_custkey AS member_id, CAST(y.yr AS STRING) AS eff_yr, lpad(CAST(m.mo AS STRING), 2, '0') AS eff_mo,
 CASE WHEN c.c_nationkey % 3 = 0 THEN ' fl' ELSE 'GA' END AS mbr_state,
 30 + c.c_custkey % 60 AS age_nbr,
 CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender_cd,
 'C' || CAST(c.c_custkey % 67 AS STRING) AS mbr_county_cd,
 'S' || CAST(c.c_custkey % 15 AS STRING) AS mbr_submarket
 FROM {customer} c CROSS JOIN (VALUES (1999), (2000)) AS y(yr)
 CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) AS m(mo)
 WHERE c.c_custkey % 50 <> 0 AND NOT (c.c_custkey % 10 = 9 AND y.yr = 2000)
   AND NOT (c.c_custkey % 10 = 8 AND m.mo > 6)""",
    "provider": """
SELECT s_suppkey AS provider_id, 'D' || CAST(s_suppkey AS STRING) AS epdb_dw_prvdr_id,
 CASE s_suppkey % 3 WHEN 0 THEN 'PCP' WHEN 1 THEN 'CARD' ELSE NULL END AS specialty_ctg_cd,
 lpad(CAST(s_suppkey % 900 AS STRING), 5, '3') AS zip_cd,
 'COUNTY ' || CAST(s_suppkey % 67 AS STRING) AS county_nm,
 'OWNER ' || CAST(s_nationkey AS STRING) AS tin_owner_nm FROM {supplier}""",
    "curated_claims": """
SELECT c.claim_line_id, c.member_id, 30 + c.member_id % 60 AS age_nbr,
 CASE WHEN c.member_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender_cd,
 'S' || CAST(c.member_id % 15 AS STRING) AS mbr_submarket, c.srv_start_dt, c.pri_icd9_dx_cd, c.business_ln_cd,
 c.srv_prvdr_id AS epdb_dw_prvdr_id,
 CASE WHEN c.srv_prvdr_id % 5 = 0 THEN NULL ELSE 'P' || CAST(c.srv_prvdr_id % 7 AS STRING) END AS prvdr_submarket,
 p.specialty_ctg_cd
 FROM {claim_line} c LEFT JOIN {provider} p ON p.provider_id = c.srv_prvdr_id
 WHERE c.med_cost_ctg_cd <> 'DENTAL'""",
    "chronic_ref": """
SELECT icd_code, 'condition ' || icd_code AS icd_description,
 CASE WHEN substr(icd_code, 1, 1) IN ('E', 'I', 'J') THEN '1' ELSE '0' END AS chronic_indicator
 FROM (SELECT DISTINCT diagnosis_code AS icd_code FROM {code_map}) z""",
    # dated entries of the code lists: of the codes ending in .2 to .5 one family each is retired,
    # moved to another category or new in the autumn between the years
    "code_version": """
SELECT m.diagnosis_code, CASE WHEN v.n = 2 AND substr(m.diagnosis_code, 2, 3) = '083' THEN '85' ELSE m.hcc_v24 END AS hcc_v24,
 CASE WHEN v.n = 1 THEN CAST('1990-01-01' AS DATE) ELSE CAST('1999-10-01' AS DATE) END AS valid_from,
 CASE WHEN v.n = 1 THEN CAST('1999-09-30' AS DATE) ELSE NULL END AS valid_to
 FROM (SELECT diagnosis_code, min(hcc_v24) AS hcc_v24 FROM {code_map} GROUP BY diagnosis_code) m
 CROSS JOIN (VALUES (1), (2)) AS v(n)
 WHERE NOT (v.n = 2 AND substr(m.diagnosis_code, 2, 3) IN ('095', '104'))
   AND NOT (v.n = 1 AND substr(m.diagnosis_code, 2, 3) = '122')""",
    "member_death": """
SELECT c_custkey AS member_id, CAST('2000-03-15' AS DATE) AS death_dt FROM {customer} WHERE c_custkey % 37 = 0""",
    "member_raw": """
SELECT c.c_custkey AS member_id,
 CAST(CAST(y.yr AS STRING) || '-' || lpad(CAST(m.mo AS STRING), 2, '0') || '-01' AS DATE) AS eff_dt,
 CASE WHEN c.c_custkey % 17 = 0 AND m.mo = 4 THEN 'N' ELSE 'Y' END AS medical_ind,
 CASE WHEN c.c_custkey % 11 = 0 THEN 'XX' WHEN c.c_custkey % 4 = 0 THEN 'CP' ELSE 'ME' END AS business_ln_cd,
 30 + c.c_custkey % 60 AS age_nbr,
 CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender_cd,
 'C' || CAST(c.c_custkey % 67 AS STRING) AS mbr_county_cd,
 CASE WHEN c.c_nationkey % 3 = 0 THEN ' fl' ELSE 'GA' END AS mbr_state,
 'S' || CAST(c.c_custkey % 15 AS STRING) AS mbr_submarket
 FROM {customer} c CROSS JOIN (VALUES (1999), (2000)) AS y(yr)
 CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) AS m(mo)
 WHERE c.c_custkey % 50 <> 0""",
}


_DX_COLUMNS = (
    "sequence_id, CASE claim_line_id % 7 WHEN 1 THEN chr(9) || icd9_dx_cd WHEN 2 THEN icd9_dx_cd || chr(13) || chr(10)"
    " ELSE icd9_dx_cd END AS icd9_dx_cd, member_id, poa_cd"
)
_CLAIM_COLUMNS = (
    "member_id, srv_start_dt, pri_icd9_dx_cd, plc_srv_cd, plc_srv_ctg_cd, med_cost_ctg_cd, business_ln_cd, srv_prvdr_id,"
    " prcdr_cd, allowed_amt, summarized_srv_ind, duplicate_ind, ntwk_srv_area_id, member_county_cd"
)


def _line_id(moved: int, end: str) -> str:
    """A line id of which every third is one hot line of year one and some are absent."""
    return (
        f"CASE WHEN claim_line_id % 3 = {moved} THEN (SELECT {end}(claim_line_id) FROM {{claim_line}}"
        " WHERE claim_line_id % 3 = 2 AND claim_line_id % 97 <> 5"
        " AND srv_start_dt >= DATE '1999-01-01' AND srv_start_dt < DATE '2000-01-01')"
        " WHEN claim_line_id % 97 = 5 THEN NULL ELSE claim_line_id END AS claim_line_id"
    )


# Both big tables with a third of their rows on one line id (one line for each table, so that
# the fan-out grows with the rows), with absent ids and, among the claims, repeated ones; codes
# of the diagnosis rows come with tabs and line ends.
HOT_VIEWS: dict[str, str] = {
    "claim_line": f"""
SELECT {_line_id(0, 'max')}, {_CLAIM_COLUMNS} FROM {{claim_line}}
UNION ALL SELECT claim_line_id, {_CLAIM_COLUMNS} FROM {{claim_line}} WHERE claim_line_id % 50 = 2""",
    "dx_line": f"SELECT {_line_id(1, 'min')}, {_DX_COLUMNS} FROM {{dx_line}}",
}


def fixture_params() -> Params:
    """The choices that go with the fixture views."""
    return Params(
        y1=1999,
        y2=2000,
        first_year=1995,
        last_year=2001,
        books={"ME": "medicare", "CP": "commercial"},
        families={"diabetes": "^E(08|09|10|11|12|13)", "control": "^I"},
        control_family="control",
        excluded_sources=("LAB", "DENTAL"),
        specialty_settings={"PCP": ("office", "outpatient"), "CARD": ("office", "outpatient", "inpatient")},
        network_areas_out=("DPPO",),
        # a twelfth of a small state: panels are half the size of real ones
        min_panel=15,
        sensitivity_panels=(10, 15, 25),
    )


def view_sql() -> dict[str, str]:
    """The view texts with plain table names, for another SQL engine."""
    names = {n: n for n in (*DRIVER_TABLES, *VIEWS)}
    return {name: text.strip().format(**names) for name, text in VIEWS.items()}


def hot_line_tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """The logical tables with both big ones as in ``HOT_VIEWS``."""
    plain = fixture_tables(spark, sf_dir)
    big = {n: plain[n] for n in HOT_VIEWS}
    hot = {n: spark.sql(text, **{m: big[m] for m in big if "{" + m + "}" in text}) for n, text in HOT_VIEWS.items()}
    return Lazy({n: (lambda n=n: hot.get(n) if n in hot else plain[n]) for n in VIEWS})


# Views of 24 rows a customer: a small file, read by one task, would be unfolded there.
UNFOLDED = ("member_month", "member_raw")


def _dealt(customer: DataFrame) -> DataFrame:
    """Customers over as many tasks as the session shuffles to; a count that is given is not coalesced."""
    return customer.repartition(int(customer.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c_custkey")


def fixture_tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """The logical tables over the parquet files of one scale, each built from
    the tables its text names when it is first asked for."""

    def build(name: str) -> DataFrame:
        if name not in VIEWS:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")
        text = VIEWS[name]
        needed = [n for n in (*DRIVER_TABLES, *VIEWS) if "{" + n + "}" in text]
        return spark.sql(text, **{n: _dealt(every[n]) if n == "customer" and name in UNFOLDED else every[n] for n in needed})

    every = Lazy({n: partial(build, n) for n in (*DRIVER_TABLES, *VIEWS)})
    return Lazy({n: partial(every.__getitem__, n) for n in VIEWS})
