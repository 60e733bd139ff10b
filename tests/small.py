"""Small hand-built domain tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

from carryover.params import Params

CLAIM = (
    "claim_line_id bigint, member_id bigint, srv_start_dt date, pri_icd9_dx_cd string, plc_srv_cd string,"
    " med_cost_ctg_cd string, business_ln_cd string, srv_prvdr_id bigint"
)
DX = "claim_line_id bigint, sequence_id string, icd9_dx_cd string, member_id bigint, poa_cd string"
MEMBER = "member_id bigint, eff_yr string, eff_mo string, mbr_state string, age_nbr bigint"
CODES = "diagnosis_code string, hcc_v24 string"


def params(**changes) -> Params:
    return Params(
        books={"ME": "medicare"}, excluded_sources=("LAB",), min_panel=1, sensitivity_panels=(1,), **changes
    )


def claims(spark: SparkSession, rows):
    return spark.createDataFrame(rows, CLAIM)


def dx(spark: SparkSession, rows):
    return spark.createDataFrame(rows, DX)


def months(spark: SparkSession, rows):
    return spark.createDataFrame(rows, MEMBER)


def code_map(spark: SparkSession, rows=(("E119", "19"), ("E1165", "18"), ("I10", None), ("Z794", "19"), ("J449", "0"))):
    return spark.createDataFrame(list(rows), CODES)


def full_coverage(member: int, until: tuple[int, int] = (2024, 12)):
    return [
        (member, str(y), f"{m:02d}", "FL", 70)
        for y in (2023, 2024)
        for m in range(1, 13)
        if (y, m) <= until
    ]


def line(claim_id, member, day, *, top="I10", place="F", source="MED", book="ME", doctor=1):
    return (claim_id, member, date.fromisoformat(day), top, place, source, book, doctor)


def position(claim_id, seq, code, member=None):
    return (claim_id, seq, code, member, "Y")
